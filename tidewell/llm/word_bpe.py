"""Encoding and decoding with a byte-pair tokenizer that works word by word.

The words of the corpus are counted, and the most frequent are compiled, with their ids,
into a lexicon: a minimal acyclic automaton whose states share suffixes, with numbers on its
edges that add up to a word's place in a table of ids. Each task maps the lexicon into
memory and sends all different words of a chunk through it side by side; words that it
doesn't hold are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import unicodedata
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.arrays import CHUNK_BYTES, flat_ranges, told_apart
from tidewell.llm.byte_bpe import byte_characters
from tidewell.llm.common import frequent, table, written
from tidewell.llm.pretoken import code_points, word_spans

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words in the lexicon at most.
LEXICON_WORDS = 60_000
#: Longer words aren't worth a place in it.
LEXICON_WORD_BYTES = 40
#: A task's counts are passed on, and its memo of merged words starts anew, beyond so many words.
COUNTED_WORDS = 300_000
MEMO_WORDS = 1_000_000
WORD_END = "</w>"


class Vocabulary:
    """The tokenizer's file: its merges, its special tokens, and the string of each id."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(re.escape(s) for s in self.specials) + ")") if self.specials else None
        self.tokens = {i: s for s, i in (spec["model"]["vocab"] | self.specials).items()}
        # A space can't occur in a word, so it stands for the end of one. Joining it to the byte
        # before comes first; then follow the merges in their order.
        value = byte_characters()
        coded = {s: bytes(value[c] for c in s.removesuffix(WORD_END)) + b" " * s.endswith(WORD_END) for s in spec["model"]["vocab"] if s not in self.specials}
        ordered = [bytes([b]) + b" " for b in range(256) if b != 32] + [coded[m[0] + m[1]] for m in spec["model"]["merges"]]
        ranks = {piece: i for i, piece in enumerate(dict.fromkeys([*ordered, *(bytes([b]) for b in range(256))]))}
        ids = {piece: spec["model"]["vocab"][s] for s, piece in coded.items() if not (piece == b" " and s != "Ġ")}
        self._id = [ids.get(piece, 0) for piece in ranks]
        self._merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def merge(self, word: str) -> list[int]:
        """Ids of one word."""
        return [self._id[i] for i in self._merge(word + " ")]

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """Normalised stretches of text, and special tokens (empty, with their id) between them."""
        if self.special is None or "<" not in text:
            return [(normalised(text), None)]
        return [("", self.specials[s]) if k % 2 else (normalised(s), None) for k, s in enumerate(self.special.split(text))]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def normalised(text: str) -> str:
    """Composed and in lower case, each character by itself; white space stays, it parts words in any form."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


class Lexicon:
    """Words and their ids in int64 arrays that follow each other in one buffer."""

    PARTS = ("keys", "targets", "before", "final", "first", "ids")

    def __init__(self, buffer: np.ndarray):
        at = len(self.PARTS)
        for name, size in zip(self.PARTS, buffer[:at].tolist(), strict=True):
            setattr(self, name, buffer[at : at + size])
            at += size

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """From a file of the task's own, which is gone once the task ends."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(np.memmap(f, np.int64, "r"))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for words that aren't in the lexicon."""
        node, number = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live, i = np.arange(len(starts)), 0
        if not len(self.keys):
            return np.full(len(starts), -1, np.int64)
        while len(live):
            done = starts[live] + i >= ends[live]
            live = live[~done]
            key = node[live] * 256 + data[starts[live] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            node[live[~hit]] = -1
            live, at = live[hit], at[hit]
            number[live] += self.before[at]
            node[live] = self.targets[at]
            i += 1
        good = node >= 0
        good[good] = self.final[node[good]] > 0
        return np.where(good, number, -1)


def compiled(words: dict[bytes, list[int]]) -> bytes:
    """The lexicon of `words`, built word by word in order so that it is minimal at all times."""
    nodes: list[tuple[dict[int, int], list[bool]]] = []  # edges and whether a word ends here

    def new() -> int:
        nodes.append(({}, [False]))
        return len(nodes) - 1

    root, same, last = new(), {}, b""
    path = [root]  # of the last word
    ordered = sorted(words)

    def settle(depth: int) -> None:
        """Replaces the last word's nodes below `depth` by equal ones that are there already."""
        while len(path) - 1 > depth:
            node = path.pop()
            edges, final = nodes[node]
            kept = same.setdefault((final[0], tuple(edges.items())), node)
            nodes[path[-1]][0][last[len(path) - 1]] = kept

    for word in ordered:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        settle(common)
        for b in word[common:]:
            child = new()
            nodes[path[-1]][0][b] = child
            path.append(child)
        nodes[path[-1]][1][0] = True
        last = word
    settle(0)
    # number the nodes that remain, children first, and count the words below each
    below: dict[int, int] = {}
    stack = [root]
    while stack:
        node = stack[-1]
        todo = [c for c in nodes[node][0].values() if c not in below]
        if todo:
            stack += todo
        else:
            below[node] = nodes[node][1][0] + sum(below[c] for c in nodes[node][0].values())
            stack.pop()
    place = {node: i for i, node in enumerate(sorted(below))}  # the root is the first
    edges, final = [], [0] * len(place)
    for node, i in place.items():
        final[i], seen = int(nodes[node][1][0]), int(nodes[node][1][0])
        for b in sorted(nodes[node][0]):
            edges.append((i * 256 + b, place[nodes[node][0][b]], seen))
            seen += below[nodes[node][0][b]]
    edges.sort()
    first = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])]) if ordered else np.zeros(1)
    parts = [*(np.array([e[k] for e in edges]) for k in range(3)), np.array(final), first, np.array([i for w in ordered for i in words[w]])]
    return np.concatenate([np.array([len(p) for p in parts]), *parts]).astype(np.int64).tobytes()


class Chunk:
    """Texts normalised and split into words, a bounded number of bytes at a time."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str | None]):
        split = [vocabulary.segments(t or "") for t in texts]
        segments = [s for parts in split for s in parts]
        self.counts = np.array([len(parts) for parts in split])  # segments of each text
        coded = [s.encode() for s, _ in segments]
        self.data = np.frombuffer(b"".join(coded), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
        self.special = [(k, i) for k, (_, i) in enumerate(segments) if i is not None]
        points, at = code_points(self.data)
        starts, ends = word_spans(points, np.searchsorted(at, offsets))
        self.starts, self.ends = at[starts], at[ends]
        self.before = np.searchsorted(self.starts, offsets)  # words before each segment
        *self.hashes, self.one, self.back = told_apart(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def text_lists(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """First row and texts of stretches of about CHUNK_BYTES; a longer text stands alone."""
    low, size, texts = 0, 0, []
    for k, t in enumerate(column.to_pylist()):
        if texts and size + len(t or "") > CHUNK_BYTES:
            yield low, texts
            low, size, texts = k, 0, []
        texts.append(t)
        size += len(t or "")
    if texts:
        yield low, texts


def word_counts(docs: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """word and n over all texts, for words of LEXICON_WORD_BYTES at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = Vocabulary(path), {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, texts in text_lists(batch.column(0)):
                chunk = Chunk(vocabulary, texts)
                for i, n in zip(chunk.one.tolist(), np.bincount(chunk.back, minlength=len(chunk.one)).tolist(), strict=True):
                    word = chunk.word(i)
                    if len(word) <= LEXICON_WORD_BYTES:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select(text).mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, text: str = "text", path: str = TOKENIZER, size: int = LEXICON_WORDS) -> bytes:
    """The most frequent words of `docs`, `size` at most, compiled. Only these reach the driver."""
    vocabulary = Vocabulary(path)
    top = frequent(written(word_counts(docs, text, path), "word-counts"), "n", size).select("word").collect()
    return compiled({r.word.encode(): vocabulary.merge(r.word) for r in top})


class Encoder:
    """Made once in each task."""

    def __init__(self, path: str, data: bytes):
        self.vocabulary, self.lexicon = Vocabulary(path), Lexicon.mapped(data)
        self.memo: dict[tuple[int, int], list[int]] = {}  # by both hashes of a word

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        chunk = Chunk(self.vocabulary, texts)
        number = self.lexicon.find(chunk.data, chunk.starts[chunk.one], chunk.ends[chunk.one])
        new = np.flatnonzero(number < 0)
        merged = []
        for *h, i in zip(*(x[new].tolist() for x in (*chunk.hashes, chunk.one)), strict=True):
            h = tuple(h)
            if h not in self.memo:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[h] = self.vocabulary.merge(chunk.word(i).decode())
            merged.append(self.memo[h])
        table = np.concatenate([self.lexicon.ids, np.array([i for m in merged for i in m], np.int64)])
        first, count = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        held = number >= 0
        first[held] = self.lexicon.first[number[held]]
        count[held] = self.lexicon.first[number[held] + 1] - first[held]
        count[new] = [len(m) for m in merged]
        first[new] = len(self.lexicon.ids) + np.cumsum(count[new]) - count[new]
        each = count[chunk.back]
        ids = table[flat_ranges(first[chunk.back], each)]
        before = np.concatenate([[0], np.cumsum(each)])[chunk.before]
        if chunk.special:
            at, values = np.array(chunk.special).T
            ids = np.insert(ids, before[at], values)
            before = before + np.searchsorted(at, np.arange(len(before)))
        cuts = before[np.concatenate([[0], np.cumsum(chunk.counts)])]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def coded(docs: DataFrame, data: bytes, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, digests: bool = False) -> DataFrame:
    """doc_id, ids and decoded of each row, or with `digests` the ids' number and both SHA-256.

    `data` is a lexicon. A null text is empty and has no ids. Rows stay apart and in place,
    equal ones too; texts and words may be of any length. Special tokens in a text are taken
    as such.
    """
    shared = docs.sparkSession.sparkContext.broadcast(data)  # bounded by LEXICON_WORDS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, shared.value)
        for batch in batches:
            for low, texts in text_lists(batch.column(1)):
                ids = encoder.encode(texts)
                decoded = [encoder.vocabulary.decode(i.tolist()) for i in ids]
                keys = batch.column(0).slice(low, len(texts))
                if digests:
                    shas = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in ([i.astype("<u4").tobytes() for i in ids], [d.encode() for d in decoded])]
                    yield pa.RecordBatch.from_arrays([keys, pa.array([len(i) for i in ids], pa.int64()), *map(pa.array, shas)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int64())), pa.array(decoded)], names=["doc_id", "ids", "decoded"])

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string"
    return docs.select(key, text).mapInArrow(task, f"doc_id {docs.schema[key].dataType.simpleString()}, {rest}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return coded(docs, lexicon(docs), digests=True)
