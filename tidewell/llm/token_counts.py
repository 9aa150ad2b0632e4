"""Counts of greedy longest-match word pieces, without building the pieces.

The vocabulary is a trie over bytes. Each node has a failure link, and with it the number of
pieces that are settled when the link is taken; so one pass over a word gives its count, in
time that is linear in its length. All different words of a chunk go through the automaton
side by side, and the longest ones alone once few are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.arrays import chunks, told_apart, words
from tidewell.llm.common import table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Stands before each word, as in the vocabulary.
WORD_START = "▁".encode()
#: So few words are faster one by one than side by side.
FEW = 64


def vocabulary(path: str = VOCABULARY) -> set[bytes]:
    """The pieces as bytes, and every single byte, which stands for what no piece covers."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return pieces | {bytes([b]) for b in range(256)}


@dataclass
class Automaton:
    """Node 0 is the root. An edge is key = node * 256 + byte."""

    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray  # where a failed node goes
    popped: np.ndarray  # pieces settled on the way there
    rest: np.ndarray  # pieces settled if the word ends here
    start: int  # the node after WORD_START
    before: int  # pieces settled when a word begins

    def steps(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        key = node * 256 + byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)

    @cached_property
    def _plain(self) -> tuple[dict[int, int], list[int], list[int]]:
        return dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True)), self.link.tolist(), self.popped.tolist()

    def _alone(self, node: int, count: int, word: bytes) -> tuple[int, int]:
        edges, link, popped = self._plain
        for b in word:
            while (step := edges.get(node * 256 + b)) is None:
                count += popped[node]
                node = link[node]
            node = step
        return node, count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word; no word is empty."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: the words that go on are a prefix
        at, length = starts[order], (ends - starts)[order]
        node, count = np.full(len(at), self.start, np.int64), np.full(len(at), self.before, np.int64)
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, "left"))
            if live <= FEW:
                for k in range(live):
                    node[k], count[k] = self._alone(int(node[k]), int(count[k]), data[at[k] + i : at[k] + length[k]].tobytes())
                break
            byte = data[at[:live] + i].astype(np.int64)
            left = np.arange(live)
            while len(left):
                step = self.steps(node[left], byte[left])
                moved = step >= 0
                node[left[moved]] = step[moved]
                left = left[~moved]
                count[left] += self.popped[node[left]]
                node[left] = self.link[node[left]]
        out = np.empty(len(at), np.int64)
        out[order] = count + self.rest[node]
        return out


def automaton(pieces: set[bytes]) -> Automaton:
    """Compiles `pieces`, which hold every single byte."""
    edges: list[dict[int, int]] = [{}]
    whole = [False]
    for piece in pieces:
        node = 0
        for b in piece:
            if b not in edges[node]:
                edges[node][b] = len(edges)
                edges.append({})
                whole.append(False)
            node = edges[node][b]
        whole[node] = True
    n = len(edges)
    link, popped, rest = [0] * n, [0] * n, [0] * n
    wave = [0]
    while wave:  # by depth, as links lead to nodes nearer the root
        later = []
        for u in wave:
            for b, v in edges[u].items():
                later.append(v)
                if whole[v]:
                    link[v], popped[v] = 0, 1
                else:  # u isn't the root, whose children are all whole
                    z, settled = link[u], popped[u]
                    while b not in edges[z]:
                        settled += popped[z]
                        z = link[z]
                    link[v], popped[v] = edges[z][b], settled
                rest[v] = popped[v] + rest[link[v]]
        wave = later
    keys, targets = np.array(sorted((u * 256 + b, v) for u, e in enumerate(edges) for b, v in e.items()), np.int64).T
    out = Automaton(np.ascontiguousarray(keys), np.ascontiguousarray(targets), *(np.array(x, np.int64) for x in (link, popped, rest)), 0, 0)
    node = settled = 0
    for b in WORD_START:
        while b not in edges[node]:
            settled += popped[node]
            node = link[node]
        node = edges[node][b]
    out.start, out.before = node, settled
    return out


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words and n_tokens of each row of `docs`.

    Words are what lies between white space (space, tab to carriage return). A text that is
    null or has no word has no token. Rows stay apart and in place, equal ones too; words
    and texts may be of any length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton(vocabulary(path)))  # as large as the vocabulary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            for low, high, data, offsets in chunks(batch.column(1), 4 << 20):
                starts, ends, before = words(data, offsets)
                *_, one, back = told_apart(data, starts, ends)
                each = machine.counts(data, starts[one], ends[one])[back]
                total = np.concatenate([[0], np.cumsum(each)])[before]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(np.diff(before), pa.int64()), pa.array(np.diff(total), pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(key, text).mapInArrow(task, f"doc_id {docs.schema[key].dataType.simpleString()}, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))
