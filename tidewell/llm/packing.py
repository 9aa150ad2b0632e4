"""Packing of token sequences into windows of equal size.

Texts are encoded and cut into full windows and a rest. Rests are dealt at random into
groups of bounded size, and each group is packed by best-fit decreasing: rests in order of
length, each into the open window with the least room that still holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.arrays import chunks
from tidewell.llm.byte_bpe import ByteLevelEncoder
from tidewell.llm.common import table, written

WINDOW = 1024
END_ID = 0
#: About so many pieces are packed together; more than enough for a tight fit.
GROUP_PIECES = 100_000
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


class RoomTree:
    """Open windows by the room they have left: a segment tree over 0 ... WINDOW."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)  # how many windows lie below each node
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window with the least room that `length` fits into, with that room; it is no longer open."""
        node = length + self.size
        if not self.open[node]:
            # up to the first subtree to the right that has an open window, then down its left side
            while node > 1 and (node & 1 or not self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.open[node]:
                    node += 1
        room = node - self.size
        self._add(room, -1)
        return self.windows[room].pop(), room

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.open[node] += n
            node >>= 1


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each length; the lengths come longest first, none above `window`."""
    tree, made, at, offsets = RoomTree(window), 0, [], []
    for length in lengths:
        found = tree.take(length) if length < window else None
        if found is None:
            found, made = (made, window), made + 1
        number, room = found
        at.append(number)
        offsets.append(window - room)
        if room > length:
            tree.put(room - length, number)
    return at, offsets


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece.

    A text, null as empty, is its ids and END_ID; it is cut into full windows and a rest,
    so it has one piece at least. `tokenizer` is a file that every executor has.
    """
    kind = docs.schema[key].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteLevelEncoder(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            for low, high, data, offsets in chunks(batch.column(1)):
                ids, before = encoder.encode(data, offsets)
                total = np.diff(before) + 1
                first = before[:-1] + np.arange(high - low)  # each text before has added one id
                ids = np.insert(ids, before[1:], END_ID).astype("<u4")
                count = -(-total // window)
                row = np.repeat(np.arange(high - low), count)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * window
                length = np.minimum(window, total[row] - start)
                begin = first[row] + start
                crc = [zlib.crc32(ids[b : b + n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(low, high - low).take(pa.array(row)), *(pa.array(np.asarray(x), pa.int64()) for x in (start, length, crc, total[row]))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(key, text).mapInArrow(task, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns of `pieces` with sequence_id and offset.

    Rows with equal keys are packed one by one; rows with null keys too. An empty table
    gives an empty one. Equal lengths are taken in order of key and start, so a group that
    is packed again comes out the same. Equal rows are dealt over the groups like others.
    """
    cut = written(pieces(docs, key, text, window, tokenizer).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = cut.count() // GROUP_PIECES + 1
    group = F.pmod(F.xxhash64("doc_id", "start", "_row"), F.lit(groups))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        at, offsets = best_fit(rows["length"].tolist(), window)
        rows["sequence_id"] = (rows["_group"].to_numpy() << 40) + np.array(at, np.int64)
        rows["offset"] = np.array(offsets, np.int64)
        return rows.drop(columns=["_group", "_row"])

    schema = f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.withColumn("_group", group).groupBy("_group").applyInPandas(pack, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
