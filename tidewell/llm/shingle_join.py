"""Exact similarity join of documents by the Jaccard similarity of their word shingles.

Two sets whose Jaccard similarity is 0.85 or more share one of their rarest shingles, so
each document's rarest shingles (about 15 %) stand in an inverted index. Documents of a list
whose sizes fit come together under the smallest of them, whole sets with them, and there a
T-occurrence search finds the links: the short inverted lists are counted, the long ones
are probed by binary search or, where most members may still reach the overlap, counted, too
(DivideSkip), and documents that reach the overlap are linked. Equal sets are one member from the start, and links inside a component that is
known already aren't looked for, so a group of near copies costs a few searches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.arrays import chunks, flat_ranges, lowered, mixed, span_hashes, words
from tidewell.llm.common import table, written
from tidewell.llm.components import components

WORDS = 4
#: Sets are linked if 100 * intersection >= PERCENT * union, unless a caller says otherwise.
PERCENT = 85
#: Counters that tell frequent shingles from rare ones; they only set the order of shingles.
COUNTER_BITS = 18
#: Slots of the filter that tells which documents have company in some list: eight a document, within these bounds.
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 28
#: Classes of shingles, by which the overlap of two sets is bounded.
CLASSES = 256
#: Groups up to this size are thinned by that bound before whole sets are moved; larger ones are split into blocks of about this size.
GROUP_MEMBERS = 256
#: Shingles in a block of a group, which is split if it has more; and visitors that are held at once.
BLOCK_SHINGLES = 1 << 20
#: Members that visit every block of a split group, about, besides the one with the most exact copies.
PIVOTS = 16
#: DivideSkip sets aside T / (MU * log2(longest list) + 1) lists for probing.
MU = 0.0085
#: Entries of a list that are counted in the time of one probe.
PROBE = 16

#: Stands for the numbers in each class where they aren't known.
_FULL = b"\xff" * (4 * CLASSES)
_WEIGHTS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must share with any set that it is linked with."""
    return -(-percent * n // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    data = lowered(data)
    starts, ends, before = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    windows = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        windows += hashes[k : k + len(windows)] * _WEIGHTS[k]
    windows = mixed(windows)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(windows[a : b - size + 1])
        elif b > a:  # the whole sequence, told from longer ones by its number of words
            yield mixed((hashes[a:b] * _WEIGHTS[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column):
        yield from shingle_sets(data, offsets, size)


def shingle_counts(docs: DataFrame, text: str, size: int = WORDS) -> np.ndarray:
    """How many documents have a shingle, counted in 2 ** COUNTER_BITS counters that shingles share."""
    block = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                slots = [s >> np.uint64(64 - COUNTER_BITS) for s in shingle_sets(data, offsets, size)]
                total += np.bincount(np.concatenate(slots).astype(np.int64), minlength=len(total))
        full = [k for k in range(0, len(total), block) if total[k : k + block].any()]
        kind = np.int32 if total.max() < 1 << 31 else np.int64
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([total[k : k + block].astype(kind).tobytes() for k in full], pa.binary())], names=["at", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros(block, np.int64), None
        for batch in batches:
            at = batch.column(0).slice(0, 1)
            for c in batch.column(1):
                c = c.as_py()
                total += np.frombuffer(c, np.int64 if len(c) == 8 * block else np.int32)
        yield pa.RecordBatch.from_arrays([at, pa.array([total.tobytes()], pa.binary())], names=["at", "counts"])

    rows = docs.select(text).mapInArrow(count, "at long, counts binary").groupBy("at").applyInArrow(add, "at long, counts binary").collect()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    for r in rows:
        out[r["at"] : r["at"] + block] = np.frombuffer(r["counts"], np.int64)
    return out


def described(docs: DataFrame, key: str, text: str, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """_doc, n, two sums that identify the set, the set's rarest shingles, and how many are in each of CLASSES classes."""
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text, size))  # 2 ** COUNTER_BITS numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            n, one, two, rare, spread = [], [], [], [], []
            for s in _sets(batch.column(1), size):
                need = len(s) - least_overlap(len(s), percent) + 1 if len(s) else 0
                order = np.argsort(counts[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")[:need]
                n.append(len(s))
                one.append(s.sum(dtype=np.uint64).view(np.int64))
                two.append(mixed(s).sum(dtype=np.uint64).view(np.int64))
                rare.append(s[order].view(np.int64))
                spread.append(np.bincount(s & np.uint64(CLASSES - 1), minlength=CLASSES).astype(np.uint16 if len(s) < 1 << 16 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(rare, pa.list_(pa.int64())), pa.array(spread, pa.binary())], names=["_doc", "n", "one", "two", "rare", "spread"])

    return docs.select(key, text).mapInArrow(task, "_doc long, n long, one long, two long, rare array<long>, spread binary")


def _slot(doc, slots: int):
    return F.pmod(F.xxhash64(doc), F.lit(slots)) + 1


def sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str, size: int = WORDS) -> DataFrame:
    """_doc and shingles (as bytes) of the documents in `wanted`, and of some others that share a slot of the filter."""
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (8 * wanted.count()).bit_length()))
    slot = _slot("_doc", slots)
    rows = wanted.select(F.bitmap_bucket_number(slot).alias("k"), F.bitmap_bit_position(slot).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    bits = np.zeros(slots // 8, np.uint8)  # MOST_SLOTS at most, whatever the number of documents
    for r in rows:
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(1).to_numpy() - 1
            keep = pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
            batch = batch.filter(keep)
            if len(batch):
                sets = [s.tobytes() for s in _sets(batch.column(2), size)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["_doc", "shingles"])

    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_doc"), _slot(F.col(key).cast("long"), slots).alias("slot"), text).mapInArrow(task, "_doc long, shingles binary")


class Block:
    """Sets side by side, with an inverted index of their shingles, in which any set can be searched for."""

    def __init__(self, sets: list[np.ndarray], labels: list[int], percent: int = PERCENT):
        self.percent, self.sets = percent, sets
        self.sizes = np.array([len(s) for s in sets])
        self.labels = np.array(labels, np.int64)  # equal: known to be in one component
        members: dict[int, list[int]] = {}
        for i, x in enumerate(labels):
            members.setdefault(x, []).append(i)
        self.members = members
        self.joined: dict[int, int] = {}  # labels that are gone, and what they are part of
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, self.owners = values[order], owner[order]
        self.begins = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
        self.lengths = np.diff(np.append(self.begins, len(values)))
        self.shingles = values[self.begins]
        # list and owner of each entry as one ascending number, which is found by binary search
        self.entries = np.repeat(np.arange(len(self.begins)), self.lengths) * len(sets) + self.owners

    def _counted(self, lists: np.ndarray) -> np.ndarray:
        return np.bincount(self.owners[flat_ranges(self.begins[lists], self.lengths[lists])], minlength=len(self.sets))

    def label(self, x: int) -> int:
        while x in self.joined:
            x = self.joined[x]
        return x

    def search(self, s: np.ndarray, label: int) -> list[int]:
        """Members linked with the set that aren't in the component of `label`, one of each component at least."""
        need = least_overlap(len(s), self.percent)
        others = self.labels != label
        if not need or not others.any() or not len(self.shingles):
            return []
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        mine = at[self.shingles[at] == s]
        if len(mine) < need:
            return []
        mine = mine[np.argsort(self.lengths[mine], kind="stable")]
        aside = min(need - 1, int(need / (MU * math.log2(max(2, self.lengths[mine[-1]])) + 1)))
        short, long = mine[: len(mine) - aside], mine[len(mine) - aside :]
        n = self._counted(short)
        enough = -(-self.percent * (len(s) + self.sizes) // (100 + self.percent))
        found = np.flatnonzero(others & (n >= enough - aside))
        if len(found) and len(long):
            if PROBE * len(found) * len(long) < self.lengths[long].sum():
                probed = long[:, None] * len(self.sets) + found
                n[found] += (self.entries[np.minimum(np.searchsorted(self.entries, probed), len(self.entries) - 1)] == probed).sum(axis=0)
            else:
                n += self._counted(long)
            found = found[n[found] >= enough[found]]
        return found[np.sort(np.unique(self.labels[found], return_index=True)[1])].tolist()

    def link(self, s: np.ndarray, label: int) -> Iterator[int]:
        """Runs the search for a set with a label and joins the components it links."""
        for d in self.search(s, label := self.label(label)):
            keep, gone = label, int(self.labels[d])
            if len(self.members.get(keep, ())) < len(self.members[gone]):
                keep, gone = gone, keep
            moved = self.members.pop(gone, [])
            self.labels[moved] = keep
            self.members[keep] += moved
            self.joined[gone] = label = keep
            yield d

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that join all that is linked. A pair is settled once one of the two has been
        searched for, so nothing is left to do when only members of the largest component haven't."""
        for q in range(len(self.sets)):
            largest = max(self.members.values(), key=len)
            if self.labels[q] != self.labels[largest[0]] or 2 * len(largest) <= len(self.sets):
                for d in self.link(self.sets[q], int(self.labels[q])):
                    yield q, d


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with equal values in the first two columns, which stand together."""
    held: list[pa.RecordBatch] = []

    def key(batch, i):
        return batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    for batch in batches:
        if not len(batch):
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(batch)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(low, high - low)
            if held and key(held[0], 0) != key(part, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _thinned(routes: DataFrame, percent: int) -> DataFrame:
    """The rows (leader, _doc, n) whose documents may be linked with another of the group.

    Two sets share no more of a class than the smaller number; where `spread` is null, any
    number. A pair from the lower of a group's two bands meets elsewhere. No group has more
    than GROUP_MEMBERS rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            keep = np.zeros(len(t), bool)
            n, top = t["n"].to_numpy(), t["top"].to_numpy()
            spread = np.array([np.frombuffer(x or _FULL, np.uint16 if x and len(x) == 2 * CLASSES else np.uint32) for x in t["spread"].to_pylist()])
            for i in range(len(t) - 1):
                rest = slice(i + 1, None)
                fits = (top[rest] | top[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
                j = np.flatnonzero(fits) + i + 1
                bound = np.minimum(spread[j], spread[i]).sum(axis=1, dtype=np.int64)
                j = j[(100 + percent) * bound >= percent * (n[j] + n[i])]
                keep[j] = True
                keep[i] |= len(j) > 0
            if keep.any():
                yield t.select(["leader", "_doc", "n"]).filter(pa.array(keep)).combine_chunks().to_batches()[0]

    dealt = routes.select("leader", F.lit(0).alias("block"), "_doc", "n", "top", "spread").repartition("leader").sortWithinPartitions("leader", "_doc")
    return dealt.mapInArrow(task, "leader long, _doc long, n long")


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[int], list[int | None], list[np.ndarray]]]:
    """The members of each block, then its visitors, about BLOCK_SHINGLES at a time: leader, block and visitor, documents, labels and sets."""
    at, docs, labels, sets, size = None, [], [], [], 0
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in range(5))
        for leader, block, visitor, label, doc, shingles in zip(*columns, batch.column(5), strict=True):
            if (leader, block, visitor) != at or visitor and size >= BLOCK_SHINGLES:
                if docs:
                    yield at, docs, labels, sets
                at, docs, labels, sets, size = (leader, block, visitor), [], [], [], 0
            docs.append(doc)
            labels.append(label)
            sets.append(np.frombuffer(shingles.as_py(), np.uint64))
            size += len(sets[-1])
    if docs:
        yield at, docs, labels, sets


def _searched(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in each block of (leader, block, visitor, label, _doc, shingles).

    Without labels, members are compared with one another. Visitors are compared with the
    members. Equal labels are one component, whose links aren't looked for.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for (*key, visitor), new_docs, new_labels, new_sets in _visits(batches):
            if not visitor:
                at, docs, strangers = key, new_docs, -1 - len(new_docs)
                # without labels, negative numbers are components of their own
                block = Block(new_sets, [-1 - i if x is None else x for i, x in enumerate(new_labels)], percent)
                if new_labels[0] is not None:
                    continue
                pairs = [(docs[p], docs[q]) for p, q in block.links()]
            elif key == at:
                pairs = [(doc, docs[d]) for i, (doc, x, s) in enumerate(zip(new_docs, new_labels, new_sets, strict=True)) for d in block.link(s, strangers - i if x is None else x)]
                strangers -= len(new_docs)
            else:  # a block without members
                continue
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    dealt = blocks.select("leader", "block", "visitor", "label", "_doc", "shingles").repartition("leader", "block").sortWithinPartitions("leader", "block", "visitor", "_doc")
    return dealt.mapInArrow(task, "a long, b long")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """_doc, n and component of every row with a key.

    Rows with one key are one node, whose links are those of all its rows. A text that is
    null, empty or white space has n 0 and no link. `docs` may have any other columns.
    """
    docs = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")).where("_doc is not null")
    own = written(described(docs, "_doc", "_text", size, percent), "shingle-sets")
    # a table of its own, so that the join below may split the copies of one text
    same = written(own.groupBy("n", "one", "two").agg(F.min("_doc").alias("first"), F.count("*").alias("copies")), "set-classes")
    # equal sets are one member: the smallest document; empty ones are nobody's
    member = own.where("n > 0").select("n", "one", "two", "_doc", "rare").join(same, ["n", "one", "two"]).select("_doc", "first", "n", "rare")
    entries = member.where("_doc = first").select("_doc", "n", F.explode("rare").alias("shingle"))
    # of two sets, the larger has at most 100 / percent times the shingles of the smaller
    fits = F.expr(f"count(*) > 2 or count(*) = 2 and 100 * min(n) >= {percent} * max(n)")
    lists = entries.groupBy("shingle").agg(fits.alias("fits")).where("fits").select("shingle")
    shared = written(entries.join(lists, "shingle", "left_semi"), "entries")
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9)
    banded = shared.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("top", F.col("band") == band)
    leaders = banded.groupBy("shingle", "band").agg(F.min("_doc").alias("leader"), F.max("_doc").alias("last")).where("leader < last").select("shingle", "band", "leader")
    # a group is a leader and a band; that two may get one number does no harm
    routes = banded.join(leaders, ["shingle", "band"]).groupBy(F.xxhash64("leader", "band").alias("leader"), "_doc", "n").agg(F.max("top").alias("top"))
    # a row's classes don't bound the links of another row with its key and size
    alike = (F.min("one") == F.max("one")) & (F.min("two") == F.max("two"))
    spread = own.groupBy("_doc", "n").agg(F.when(alike, F.any_value("spread")).alias("spread"))
    routes = written(routes, "routes")
    # large groups don't come together before they are split
    large = written(routes.groupBy("leader").count().where(F.col("count") > GROUP_MEMBERS).select("leader"), "large-groups")
    small = routes.join(large, "leader", "left_anti").join(spread, ["_doc", "n"])
    routes = written(_thinned(small, percent).union(routes.join(large, "leader", "left_semi").select("leader", "_doc", "n")), "routes")
    sets = written(sets_of(docs, routes.select("_doc").distinct(), "_doc", "_text", size), "sets")
    # large groups, and those with many shingles, are dealt over blocks
    blocks = F.greatest(F.sum("n") / BLOCK_SHINGLES, (F.count("*") - 1) / GROUP_MEMBERS) + 1
    groups = routes.groupBy("leader").agg(blocks.cast("long").alias("blocks"), F.count("*").alias("members"))
    seats = written(routes.join(groups, "leader").withColumn("block", F.pmod(F.xxhash64("_doc", "leader"), F.col("blocks"))), "seats")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pivots = seats.where("blocks > 1").where(F.pmod(F.xxhash64("_doc", F.lit(7)), F.col("members")) < PIVOTS)
    # near copies are nearest to the text that they are copies of, which often has exact copies
    copies = same.where("copies > 1").groupBy(F.col("first").alias("_doc")).agg(F.max("copies").alias("copies"))
    heads = seats.where("blocks > 1").join(copies, "_doc").groupBy("leader").agg(F.max_by("_doc", F.struct("copies", "_doc")).alias("_doc"))
    pivots = pivots.unionByName(seats.join(heads, ["leader", "_doc"], "left_semi")).distinct()
    guests = pivots.withColumnRenamed("block", "home").withColumn("block", everywhere).where("block <> home")
    columns = ["leader", "block", "_doc"]
    first = seats.select(*columns, F.lit(0).alias("visitor")).union(guests.select(*columns, F.lit(1).alias("visitor"))).withColumn("label", F.lit(None).cast("long"))
    links = written(_searched(first.join(sets, "_doc"), percent), "links")
    split = seats.where("blocks > 1")
    if not split.isEmpty():
        # between blocks: whoever isn't in a group's largest component visits its other blocks
        known = components(links)
        labelled = written(split.join(known.withColumnRenamed("node", "_doc"), "_doc", "left").withColumn("label", F.coalesce("component", "_doc")).drop("component"), "labelled")
        parts = labelled.groupBy("leader", "label").agg(F.count("*").alias("m"))
        largest = parts.groupBy("leader").agg(F.max_by("label", F.struct("m", "label")).alias("most"))
        visitors = labelled.join(largest, "leader").where("label <> most").withColumnRenamed("block", "home").withColumn("block", everywhere).where("block <> home")
        columns = ["leader", "block", "_doc"]
        second = labelled.select(*columns, F.lit(0).alias("visitor"), "label").union(visitors.select(*columns, F.lit(1).alias("visitor"), "label"))
        met = second.join(visitors.select("leader", "block").distinct(), ["leader", "block"], "left_semi")
        links = links.union(written(_searched(met.join(sets, "_doc"), percent), "links"))
    # rows with one key but different sets are tied together by their edges
    tied = member.where("_doc <> first").select(F.col("_doc").alias("a"), F.col("first").alias("b"))
    found = components(links.union(tied))
    out = own.select("_doc", "n").join(found.withColumnRenamed("node", "_doc"), "_doc", "left")
    return out.select("_doc", "n", F.coalesce("component", "_doc").alias("component"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select(F.col("_doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id::BIGINT AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN components USING (doc_id)
"""
