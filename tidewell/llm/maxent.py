"""Language model: hashed maximum entropy with a class-factored softmax.

Words are the leaves of a tree of classes, made so that frequent words have short ways: each
class has WIDTH children at most, which are classes or words. The probability of a word is
the product of the choices on its way, and each choice is a softmax over a class's children,
whose scores are sums: the logarithm of the child's share of the class's counts, and a row of
weights for each feature. There is a table of rows for each kind of feature, and a row is found
by hashing the feature together with the class. The features are the word before, the second
word before alone, and the pair; any words make features, however rare. Words that aren't among
the KNOWN_WORDS most frequent are one leaf, and within it a word's count decides, looked up by
a join. Counts are of all training rows, and the tables have more rows the more tokens there are.

Training is data-parallel: in each round every task updates its copy of the tables by
gradient steps over its documents, and the changes of a row are averaged over the tasks that
have updated it, each weighed by its number of updates. Each training document is used in one
round. Documents are dealt to tasks by hash, and the number of tasks follows the number of
tokens, so the scores don't depend on the cluster.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.arrays import chunks, flat_ranges, lowered, mixed, span_hashes, words
from tidewell.llm.common import frequent, table, written

#: Children of a class at most.
WIDTH = 32
#: Words in the tree, whose counts every task knows.
KNOWN_WORDS = 1 << 18
#: Base-2 logarithms of the rows of a table: the least, the most, and that of the tokens for each row beyond the least.
LEAST_ROWS, MOST_ROWS, ROW_TOKENS = 16, 17, 12
#: Shares of the training documents that the rounds use, in sixteenths.
ROUNDS = (4, 12)
#: Training tokens of a task for each row of a table: a task passes on as much as the tables
#: have rows. Few tokens are dealt to FEW_TASKS nevertheless, of LEAST_TOKENS at least.
TASK_TOKENS, FEW_TASKS, LEAST_TOKENS = 160, 4, 1 << 19
RATE = 0.25
#: Decisions of a gradient step, and those that are scored together.
STEP, SCORED = 32768, 8192
#: Rows of weights that are averaged together.
BLOCK = 256

END = mixed(np.array([0xE0D], np.uint64))[0]
_BEGIN = mixed(np.array([0xBE6], np.uint64))[0]
#: Kinds of features: the word before, the second before, and the pair before.
_KINDS = mixed(np.arange(1, 4, dtype=np.uint64))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, with one END after each text, and how many lie before each text."""
    data = lowered(data)
    starts, ends, before = words(data, offsets)
    return np.insert(span_hashes(data, starts, ends), before[1:], END), before + np.arange(len(before))


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """token (hash) and c over all rows of `docs`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            token, back = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return token, np.bincount(back, np.concatenate([c for _, c in held]), len(token)).astype(np.int64)

        def out(token, count):
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], names=["token", "c"])

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                held.append(np.unique(tokens(data, offsets)[0], return_counts=True))
                if sum(len(t) for t, _ in held) > 1_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 500_000:
                        yield out(*held.pop())
        if held:
            yield out(*merged())

    return docs.select(text).mapInArrow(task, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def tree_of(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree whose leaves have the least weighted depth: for all leaves in turn the classes on
    the way and the children taken there, where each leaf's part begins, and each class's number of children."""
    n = len(weights)
    leaves = deque(zip(np.sort(weights, kind="stable").tolist(), np.argsort(weights, kind="stable").tolist(), strict=True))
    made: deque[tuple[float, int]] = deque()
    up, slot, sizes = [0] * n, [0] * n, []
    many = (n - 2) % (WIDTH - 1) + 2  # so that all later classes are full
    while len(leaves) + len(made) > 1:
        total = 0
        for k in range(many):
            part, node = leaves.popleft() if leaves and (not made or leaves[0][0] <= made[0][0]) else made.popleft()
            total, up[node], slot[node] = total + part, n + len(sizes), k
        made.append((total, n + len(sizes)))
        up.append(0)
        slot.append(0)
        sizes.append(many)
        many = WIDTH
    root, up, slot = n + len(sizes) - 1, np.array(up), np.array(slot)
    node, steps = np.arange(n), []
    while len(sizes) and (on := node != root).any():
        steps.append((np.where(on, root - up[node], -1), slot[node]))
        node = np.where(on, up[node], root)
    if not steps:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    classes, children = (np.stack(x, axis=1) for x in zip(*steps, strict=True))
    there = classes >= 0
    begins = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
    return classes[there].astype(np.int32), children[there].astype(np.int32), begins, np.array(sizes[::-1])


@dataclass
class Vocabulary:
    """Frequent words by hash; their ways through the tree follow from their counts."""

    hashes: np.ndarray  # sorted
    rank: np.ndarray
    count: np.ndarray  # by rank
    total: int  # N
    distinct: int  # V

    def __post_init__(self):
        n = len(self.count)
        rest = self.total - int(self.count.sum())
        mass = np.append(self.count, rest)  # the last leaf is for all other words
        self.classes, self.children, self.begins, sizes = tree_of(mass)
        self.rare_log = math.log10(rest + 0.5 * (self.distinct - n + 1))
        self.base_log = math.log10(self.total + 0.5 * (self.distinct + 1))
        self.known_log = np.append(np.log10(self.count + 0.5), 0.0)
        # children that don't exist get no probability
        share = np.bincount(self.classes * np.int64(WIDTH) + self.children, np.repeat(mass, np.diff(self.begins)), len(sizes) * WIDTH).reshape(-1, WIDTH)
        share = np.log(np.maximum(share, 0.5) / np.maximum(share.sum(axis=1, keepdims=True), 0.5))
        self.prior = np.where(np.arange(WIDTH) < sizes[:, None], share, -1e9).astype(np.float32)
        bits = max(0, int(self.total).bit_length() - ROW_TOKENS)
        self.rows = 1 << min(MOST_ROWS, max(LEAST_ROWS, bits))
        self.tasks = max(min(FEW_TASKS, self.total // LEAST_TOKENS + 1), self.total // (TASK_TOKENS * self.rows) + 1)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """The rank of each token, the number of frequent words for others."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), n - 1)
        return np.where(self.hashes[at] == hashes, self.rank[at], n)


def decisions(vocabulary: Vocabulary, token: np.ndarray, rank: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the model decides at each token: rows of each table, class, child, and the token decided upon."""
    n = len(token)
    place = np.arange(n) - np.repeat(before[:-1], np.diff(before))
    back = []
    for k in (1, 2):
        w = np.full(n, _BEGIN, np.uint64)
        w[k:] = np.where(place[k:] >= k, token[: max(0, n - k)], _BEGIN)
        back.append(w)
    features = [mixed(x + kind) for x, kind in zip((*back, mixed(back[0]) + back[1]), _KINDS, strict=True)]
    count = vocabulary.begins[rank + 1] - vocabulary.begins[rank]
    at, way = np.repeat(np.arange(n), count), flat_ranges(vocabulary.begins[rank], count)
    node, child = vocabulary.classes[way], vocabulary.children[way]
    own = mixed(node.astype(np.uint64) + np.uint64(77))
    low = np.uint64(vocabulary.rows - 1)
    # multiplied and taken from the top: every bit of both counts
    rows = np.stack([(((f[at] ^ own) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & low for f in features])
    return rows.astype(np.int32), node, child, at


def spread(n: int) -> np.ndarray:
    """Numbers below n in an order in which neighbours lie far apart, as words of a text are alike."""
    order = np.arange(-(-n // STEP) * STEP).reshape(STEP, -1).T.ravel()
    return order[order < n]


def _scores(weights: np.ndarray, prior: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The scores of a class's children, less the largest of them."""
    out = prior.take(node, axis=0)
    for table, r in zip(weights, rows, strict=True):
        out += table.take(r, axis=0)
    out -= out.max(axis=1, keepdims=True)
    return out


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key of the sorted keys, how often it occurs, and the sum of its rows of `values`, which is overwritten.

    Rows of one key are added in pairs, then the sums of pairs, and so on; keys that occur once cost nothing.
    """
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(begins, len(key)))
    place = np.arange(len(key)) - np.repeat(begins, n)
    left = np.repeat(n, n) - place  # rows of the key from here on
    at, step = np.arange(len(key)), 1
    while len(at := at[(place[at] % (2 * step) == 0) & (left[at] > step)]):
        values[at] = values.take(at, axis=0) + values.take(at + step, axis=0)
        step *= 2
    return key[begins], n, values.take(begins, axis=0)


class Trainer:
    """A task's copy of the weights, with the sum of squared gradients and the updates of each row."""

    def __init__(self, vocabulary: Vocabulary, weights: np.ndarray):
        self.vocabulary, self.before, self.weights = vocabulary, weights, weights.copy()
        self.squares, self.updates = np.full(weights.shape[:2], 1e-6, np.float32), np.zeros(weights.shape[:2], np.int32)
        self.sorts = np.uint16 if weights.shape[1] <= 1 << 16 else np.uint32  # 16 bits are sorted by counting

    def learn(self, rows: np.ndarray, node: np.ndarray, child: np.ndarray) -> None:
        for low in range(0, len(node), STEP):
            part = slice(low, low + STEP)
            slope = _scores(self.weights, self.vocabulary.prior, rows[:, part], node[part])
            np.exp(slope, out=slope)
            slope /= slope.sum(axis=1, keepdims=True)
            slope[np.arange(len(slope)), child[part]] -= 1
            for r, weights, squares, updates in zip(rows[:, part], self.weights, self.squares, self.updates, strict=True):
                order = np.argsort(r.astype(self.sorts), kind="stable")
                row, n, total = _summed(r[order], slope.take(order, axis=0))
                squares[row] += np.einsum("ij,ij->i", total, total) / WIDTH
                updates[row] += n
                total *= (RATE / np.sqrt(squares[row]))[:, None]
                weights[row] = weights.take(row, axis=0) - total

    def changes(self, group: int) -> Iterator[pa.RecordBatch]:
        updates = self.updates.ravel()
        touched = np.flatnonzero(updates)
        change = (self.weights.reshape(-1, WIDTH)[touched] - self.before.reshape(-1, WIDTH)[touched]).astype(np.float16)
        cuts = np.searchsorted(touched, np.arange(0, len(updates) + 1, BLOCK)).tolist()
        parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in parts], pa.int64()), pa.array([group] * len(parts), pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in parts], pa.binary()) for x in ((touched % BLOCK).astype(np.uint8), updates[touched], change))],
            names=["block", "group", "rows", "updates", "change"],
        )


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block and change of all rows of each block. The rows come by block and group, and are added as they come."""

    def out():
        change = (total / np.maximum(weight, 1)).astype(np.float32)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([change.tobytes()], pa.binary())], names=["block", "change"])

    at = None
    for batch in batches:
        for block, rows, updates, change in zip(*(batch.column(c) for c in (0, 2, 3, 4)), strict=True):
            if block.as_py() != at:
                if at is not None:
                    yield out()
                at, total, weight = block.as_py(), np.zeros((BLOCK, WIDTH)), np.zeros((BLOCK, 1))
            place, n = np.frombuffer(rows.as_py(), np.uint8), np.frombuffer(updates.as_py(), np.int32)[:, None]
            total[place] += n * np.frombuffer(change.as_py(), np.float16).reshape(-1, WIDTH).astype(float)
            weight[place] += n
    if at is not None:
        yield out()


def trained(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary) -> np.ndarray:
    """The tables of weights after all rounds, each over its share of `docs`."""
    weights = np.zeros((len(_KINDS), vocabulary.rows, WIDTH), np.float32)
    if not len(vocabulary.prior):
        return weights
    dealt = docs.select(F.xxhash64(F.lit(len(ROUNDS)), key, text).alias("order"), text)
    for k, share in enumerate(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))  # KNOWN_WORDS words and at most 2 ** MOST_ROWS rows a table

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, weights = shared.value
            at = trainer = None
            for batch in batches:
                group = batch.column(0).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)] if len(group) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if group[a] != at:
                        if trainer is not None:
                            yield from trainer.changes(at)
                        at, trainer = int(group[a]), Trainer(vocabulary, weights)
                    for _, _, data, offsets in chunks(batch.column(1).slice(a, b - a), 1 << 18):
                        token, before = tokens(data, offsets)
                        rows, node, child, _ = decisions(vocabulary, token, vocabulary.ranks(token), before)
                        order = spread(len(node))
                        trainer.learn(rows[:, order], node[order], child[order])
            if trainer is not None:
                yield from trainer.changes(at)

        begin = sum(ROUNDS[:k])
        mine = dealt.where(F.pmod("order", F.lit(sum(ROUNDS))).between(begin, begin + share - 1))
        # a partition may get several groups, which are trained apart all the same
        mine = mine.withColumn("group", F.pmod(F.xxhash64("order"), F.lit(vocabulary.tasks))).repartition(4 * vocabulary.tasks, "group").sortWithinPartitions("group", "order")
        changes = mine.select("group", text).mapInArrow(task, "block long, group long, rows binary, updates binary, change binary")
        flat = weights.copy().reshape(-1, WIDTH)
        for r in changes.repartition("block").sortWithinPartitions("block", "group").mapInArrow(_averaged, "block long, change binary").collect():
            flat[r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(r.change, np.float32).reshape(BLOCK, WIDTH)
        weights = flat.reshape(weights.shape)
        shared.unpersist()
    return weights


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = frequent(counts, "c", KNOWN_WORDS).toPandas().sort_values(["c", "token"], ascending=[False, True])
    hashes = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], order, top["c"].to_numpy(np.int64), int(total.n), int(total.v))


def scored(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", modelled: bool = True) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of `docs`; no score, and no model, unless `modelled`.

    The model learns from the rows where `training` holds. A null text is empty and has one
    token, its end; with nothing to learn from, all words are equally unknown. Rows stay
    apart, equal ones too. Counts are those of all training rows: what isn't among the
    frequent words is looked up by a join. The scores are the same on any number of cores.
    """
    learned = docs.where(training)
    counts = written(token_counts(learned, text), "token-counts")
    vocabulary = vocabulary_of(counts)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, trained(learned, key, text, vocabulary) if modelled else None))
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights = shared.value
        row = TaskContext.get().partitionId() << 36
        n = len(vocabulary.count)
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(1), 1 << 18):
                token, before = tokens(data, offsets)
                rank = vocabulary.ranks(token)
                rows, node, child, at = decisions(vocabulary, token, rank, before) if modelled else (None, (), None, None)
                each = np.zeros(len(token))
                for a in range(0, len(node), SCORED):
                    part = slice(a, a + SCORED)
                    logs = _scores(weights, vocabulary.prior, rows[:, part], node[part])
                    np.add.at(each, at[part], (logs[np.arange(len(logs)), child[part]] - np.log(np.exp(logs).sum(axis=1))) / math.log(10))
                rare = rank == n
                base = vocabulary.known_log[rank] - vocabulary.base_log
                each -= rare * vocabulary.rare_log
                sums = [np.add.reduceat(x, before[:-1]) for x in (each, base, (~rare).astype(np.int64))]
                where = np.flatnonzero(rare)
                cuts = np.searchsorted(where, before)
                rest = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(token[where].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(row + np.arange(high - low)), pa.array(np.diff(before)), pa.array(sums[2]), pa.array(sums[1]), pa.array(sums[0]), rest],
                    names=["doc_id", "row", "n_tokens", "n_known", "base_score", "score", "rest"],
                )
                row += high - low

    parts = written(docs.select(key, text).mapInArrow(task, f"doc_id {kind}, row long, n_tokens long, n_known long, base_score double, score double, rest array<long>"), "scores")
    # rare words: log10(c + 0.5) counts in both scores
    rest = parts.select("row", F.explode("rest").alias("token")).groupBy("row", "token").agg(F.count("*").alias("tf"))
    rest = rest.join(counts, "token", "left").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("known"))
    both = parts.drop("rest").join(rest, "row", "left")
    zero = F.coalesce("log", F.lit(0.0))
    out = both.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + zero).alias("base_score"), (F.col("score") + zero).alias("score"))
    return out if modelled else out.drop("score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _columns(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What `query` returns of counts, by the same steps without the model; sums to three places, as their order differs from that of SQL."""
    out = _columns(spark, sf_dir, modelled=False)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


def _columns(spark: SparkSession, sf_dir: str, modelled: bool = True) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")), modelled=modelled)
    return out.withColumn("held_out", is_held_out(F.col("doc_id")))


# crc32 bit by bit: each byte comes with seven zeros, and each step shifts by one
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295)"
BASE_ORACLE = f"""
WITH tokens AS (
  SELECT doc_id, {_CRC} % 5 = 1 AS held_out,
         unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '')) AS token
  FROM documents
), counts AS (
  SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token
), total AS (
  SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM counts
)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 3) AS base_score
FROM tokens LEFT JOIN counts USING (token) CROSS JOIN total GROUP BY doc_id
"""
