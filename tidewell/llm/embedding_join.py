"""Exact near-duplicate join of vectors by cosine: a metric range join.

Pivots split the sphere into small cells, one vector belonging to the cell of its nearest
pivot. The triangle inequality bounds how far a neighbour can lie, so it is known which other
cells could hold one. Neighbouring cells make up blocks, each compared on its own: a vector is
at home in one block and a guest, once, in every other that has such cells, where it meets the
vectors of these cells only. Of two blocks, one receives the other's guests, so each pair is
compared once, and what a guest finds is added to its own links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.arrays import mixed
from tidewell.llm.common import table, written
from tidewell.llm.components import components

COSINE = 0.95
#: Vectors that a cell has on average, while there are fewer pivots than MAX_PIVOTS.
CELL_VECTORS = 64
#: Pivots at most for each length: they are broadcast.
MAX_PIVOTS = 4096
#: Pivots are means of about so many vectors each, found in so many rounds on a sample.
PIVOT_SAMPLE, PIVOT_ROUNDS = 8, 3
#: A block has a share of all vectors, but so many at least, and so many components of vectors at most.
BLOCK_SHARE, LEAST_BLOCK, MOST_BLOCK_VALUES = 12, 1024, 1 << 22
#: Vectors are compared so many at a time.
TOGETHER = 1024
#: Slack for rounding in the bounds; it can only add guests.
SLACK = 1e-9


def members(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """_vec, _values, and _one and _two, which identify the values; only vectors that can have links."""
    kind = "float" if vectors.schema[embedding].dataType == T.ArrayType(T.FloatType()) else "double"
    own = vectors.select(F.col(key).cast("long").alias("_vec"), F.col(embedding).cast(f"array<{kind}>").alias("_values"))
    good = F.col("_vec").isNotNull() & F.forall("_values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_values", lambda x: x != 0)
    return own.where(good).select("_vec", "_values", F.xxhash64("_values").alias("_one"), F.xxhash64(F.lit(1), "_values").alias("_two"))


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and values, by length of the vectors."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(offsets)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        yield rows, values[offsets[:-1][rows][:, None] + np.arange(n)]


def _centres(sample: np.ndarray, k: int) -> np.ndarray:
    """At most `k` unit vectors that the sample lies around."""
    sample = np.unique(sample, axis=0)
    centres = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(PIVOT_ROUNDS):
        nearest = np.concatenate([(sample[a : a + 1024] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres)
    return np.unique(centres, axis=0)


def pivots_of(own: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Pivots for each length of the vectors, and how many vectors have it. The sample is bounded: PIVOT_SAMPLE vectors a pivot."""
    size = F.size("_values")
    counts = {r.n: r["count"] for r in own.groupBy(size.alias("n")).count().collect()}
    pivots = {}
    for n, count in sorted(counts.items()):
        wanted = min(MAX_PIVOTS, count // CELL_VECTORS + 1)
        pivots[n] = np.full((1, n), 1 / math.sqrt(n))
        if wanted > 1:
            # any vectors will do; a hash picks the same ones each time, equal vectors by their keys
            share = int(min(1, wanted * PIVOT_SAMPLE / count) * (1 << 40)) + 1
            chosen = own.where((size == n) & (F.pmod(F.xxhash64("_vec", "_one"), F.lit(1 << 40)) < share)).select("_values").limit(2 * wanted * PIVOT_SAMPLE).toArrow()
            if len(chosen):
                (_, values), = _by_length(chosen.column(0).combine_chunks())
                pivots[n] = _centres(_units(values), wanted)
    return pivots, counts


def _homes(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """_rep, copies, values (bytes), their number, the cell and the angle to the cell's pivot."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in _by_length(batch.column(2)):
                nearest = []
                for low in range(0, len(rows), TOGETHER):
                    cosine = _units(values[low : low + TOGETHER]) @ shared.value[values.shape[1]].T
                    nearest.append((cosine.argmax(axis=1), cosine.max(axis=1)))
                cell, cosine = (np.concatenate(x) for x in zip(*nearest, strict=True))
                angle = np.arccos(np.clip(cosine, -1, 1))
                part, n = batch.take(pa.array(rows)), pa.array(np.full(len(rows), values.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([v.tobytes() for v in values], pa.binary()), n, pa.array(cell), pa.array(angle)], names=["_rep", "copies", "values", "n", "cell", "angle"])

    return reps.select("_rep", "copies", "_values").mapInArrow(task, "_rep long, copies long, values binary, n long, cell long, angle double")


@dataclass
class Layout:
    """How the cells of vectors of one length lie in blocks."""

    pivots: np.ndarray
    radius: np.ndarray  # the largest angle of a cell's vectors; no cell without vectors is near anything
    order: np.ndarray  # cells, those of one group side by side
    begins: np.ndarray  # of each group in that order
    group: np.ndarray  # of each cell
    place: np.ndarray  # of each cell in its group
    first: np.ndarray  # block of each group
    blocks: np.ndarray  # of each group; more than one only where a cell is large

    def near(self, units: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """Which cells, in `order`, may hold a neighbour of each vector."""
        cos = units @ self.pivots.T
        own = cos[np.arange(len(home)), home][:, None]
        apart = np.sqrt(np.maximum(2 - 2 * self.pivots[home] @ self.pivots.T, 1e-30))
        # neither beyond the cell's radius nor too far from the plane between the two pivots
        out = (np.arccos(np.clip(cos, -1, 1)) <= self.radius + reach + SLACK) & ((own - cos) / apart <= math.sin(reach) + SLACK)
        out[np.arange(len(home)), home] = True
        return out[:, self.order]


def laid_out(pivots: np.ndarray, radius: np.ndarray, sizes: np.ndarray, limit: int, first: int) -> Layout:
    """Cells are halved across their pivots' widest direction until a group's vectors are a block's at most."""
    groups, todo = [], [np.arange(len(pivots))]
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or sizes[cells].sum() <= limit:
            groups.append(cells)
            continue
        centred = pivots[cells] - pivots[cells].mean(axis=0)
        direction = centred[np.abs(centred).sum(axis=1).argmax()]
        for _ in range(8):
            direction = centred.T @ (centred @ direction)
            direction /= max(np.sqrt(direction @ direction), 1e-300)
        cells = cells[np.argsort(centred @ direction, kind="stable")]
        half = np.searchsorted(np.cumsum(sizes[cells]), sizes[cells].sum() / 2) + 1
        half = min(max(int(half), 1), len(cells) - 1)
        todo += [cells[half:], cells[:half]]
    order = np.concatenate(groups)
    lengths = np.array([len(g) for g in groups])
    begins = np.cumsum(lengths) - lengths
    group, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(groups)), lengths)
    place[order] = np.arange(len(order)) - np.repeat(begins, lengths)
    blocks = np.array([max(1, -(-int(sizes[g].sum()) // limit)) if len(g) == 1 else 1 for g in groups])
    return Layout(pivots, radius, order, begins, group, place, first + np.cumsum(blocks) - blocks, blocks)


def _visits(home: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of two blocks sends guests to the other: each the same number, about."""
    return (home < other) == ((home + other) % 2 == 0)


def routed(homes: DataFrame, layouts: dict[int, Layout], kind: np.dtype, cosine: float) -> DataFrame:
    """Each vector at home (guest 0) and as a guest (1): its block, its cell's place there, and
    the places of the cells to meet as bits."""
    reach = math.acos(cosine)
    shared = homes.sparkSession.sparkContext.broadcast(layouts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part, block, guest, place, bits):
            n = len(part)
            return pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), pa.array(np.full(n, guest), pa.int32()), pa.array(place, pa.int64()), pa.array(bits, pa.binary()), part.column(0), part.column(1), part.column(2)],
                names=["block", "guest", "place", "meets", "_rep", "copies", "values"],
            )

        for batch in batches:
            length = batch.column(3).to_numpy()
            for n in np.unique(length).tolist():
                all_, layout = batch.take(pa.array(np.flatnonzero(length == n))), shared.value[n]
                for low in range(0, len(all_), TOGETHER):
                    part = all_.slice(low, TOGETHER)
                    units = _units(np.frombuffer(b"".join(part.column(2).to_pylist()), kind).reshape(-1, n))
                    cell, rep = part.column(4).to_numpy(), part.column(0).to_numpy()
                    near, group = layout.near(units, cell, reach), layout.group[cell]
                    sub = (mixed(rep.view(np.uint64)) % layout.blocks[group].astype(np.uint64)).astype(np.int64)
                    home = layout.first[group] + sub
                    ends = np.append(layout.begins[1:], len(layout.order))
                    for g, (a, b) in enumerate(zip(layout.begins.tolist(), ends.tolist(), strict=True)):
                        wanted = np.flatnonzero(near[:, a:b].any(axis=1))
                        if not len(wanted):
                            continue
                        bits = np.packbits(near[wanted, a:b], axis=1)
                        for block in range(layout.first[g], layout.first[g] + layout.blocks[g]):
                            here = home[wanted] == block
                            for guest, rows in ((0, np.flatnonzero(here)), (1, np.flatnonzero(~here & _visits(home[wanted], block)))):
                                if len(rows):
                                    at = wanted[rows]
                                    yield out(part.take(pa.array(at)), np.full(len(at), block), guest, layout.place[cell[at]], [x.tobytes() for x in bits[rows]])

    return homes.select("_rep", "copies", "values", "n", "cell").mapInArrow(task, "block long, guest int, place long, meets binary, _rep long, copies long, values binary")


class Block:
    """The vectors that are at home in a block, by cell, their links so far, and the components these make."""

    def __init__(self, reps: np.ndarray, copies: np.ndarray, values: np.ndarray, place: np.ndarray, cosine: float):
        self.reps, self.copies, self.values, self.cosine = reps, copies, values, cosine
        self.single = _units(values).astype(np.float32)
        #: by how much a cosine of single precision may be wrong
        self.doubt = (values.shape[1] + 8) * 2.0**-23
        self.places = np.unique(place)
        self.cuts = np.append(np.searchsorted(place, self.places), len(place)).tolist()
        self.links = np.zeros(len(reps), np.int64)
        self.parent = np.arange(len(reps))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.parent[a], self.parent[b]
        apart = a != b
        if not apart.any():
            return
        n = len(self.parent)
        for pair in np.unique(a[apart] * n + b[apart]).tolist():
            x, y = self.root(pair // n), self.root(pair % n)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
        while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = up

    def meet(self, copies: np.ndarray, values: np.ndarray, meets: np.ndarray, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Compares vectors with those of the cells they are to meet, and adds to these their
        links. Of each: its links with them, and the first of them (-1 if none). With `own` the
        vectors are the block's from that one on, which meet only those that come after them."""
        units = _units(values).astype(np.float32) if own is None else self.single[own : own + len(values)]
        links, first = np.zeros(len(values), np.int64), np.full(len(values), -1, np.int64)
        for place, low, high in zip(self.places.tolist(), self.cuts[:-1], self.cuts[1:], strict=True):
            if own is not None and high <= own + 1:
                continue
            rows = np.flatnonzero(meets[:, place])
            if not len(rows):
                continue
            whole = len(rows) == len(units)
            for a in range(low, high, TOGETHER):
                found = (units if whole else units[rows]) @ self.single[a : min(high, a + TOGETHER)].T
                i, j = np.divmod(np.flatnonzero(found.ravel() >= self.cosine - self.doubt), found.shape[1])
                if not len(i):
                    continue
                value = found[i, j]
                i, j = rows[i], j + a
                keep = np.ones(len(i), bool) if own is None else j > own + i
                unsure = np.flatnonzero(keep & (value < self.cosine + self.doubt))
                for k in range(0, len(unsure), TOGETHER):
                    u = unsure[k : k + TOGETHER]
                    keep[u] = np.einsum("ij,ij->i", _units(values[i[u]]), _units(self.values[j[u]])) >= self.cosine
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                np.add.at(links, i, self.copies[j])
                np.add.at(self.links, j, copies[i])
                who, at = np.unique(i, return_index=True)
                new = first[who] < 0
                first[who[new]] = j[at[new]]
                self.join(first[i] if own is None else own + i, j)
        return links, first


def _compared(blocks: DataFrame, kind: np.dtype, cosine: float) -> DataFrame:
    """Rows (a, b, links): each vector of a block with its component's first vector there, and
    each linked guest with one that it is linked with; and how many links of a were found."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, links):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

        def columns(parts):
            place, reps, copies = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (2, 4, 5))
            values = np.frombuffer(b"".join(v for p in parts for v in p.column(6).to_pylist()), kind).reshape(len(reps), -1)
            meets = np.unpackbits(np.frombuffer(b"".join(v for p in parts for v in p.column(3).to_pylist()), np.uint8).reshape(len(reps), -1), axis=1).astype(bool)
            return place, reps, copies, values, meets

        home, waiting, at = None, [], None

        def ready():
            place, reps, copies, values, meets = columns(waiting)
            waiting.clear()
            made = Block(reps, copies, values, place, cosine)
            for low in range(0, len(reps), TOGETHER):
                part = slice(low, low + TOGETHER)
                made.links[part] += made.meet(copies[part], values[part], meets[part], low)[0]
            return made

        def done(h):
            # equal vectors are linked; a vector is at home once
            return out(h.reps, h.reps[h.parent], h.links + h.copies - 1)

        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(2)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                block, guest = keys[low].tolist()
                if block != at:
                    if waiting:
                        home = ready()
                    if home is not None:
                        yield done(home)
                    home, at = None, block
                if not guest:
                    waiting.append(batch.slice(low, high - low))
                    continue
                if waiting:
                    home = ready()
                if home is None:  # a block with guests only
                    continue
                for k in range(low, high, TOGETHER):
                    _, reps, copies, values, meets = columns([batch.slice(k, min(TOGETHER, high - k))])
                    links, first = home.meet(copies, values, meets)
                    who = np.flatnonzero(first >= 0)
                    if len(who):
                        yield out(reps[who], home.reps[first[who]], links[who])
        if waiting:
            home = ready()
        if home is not None:
            yield done(home)

    dealt = blocks.select("block", "guest", "place", "meets", "_rep", "copies", "values").repartition("block").sortWithinPartitions("block", "guest", "place", "_rep")
    return dealt.mapInArrow(task, "a long, b long, links long")


def arranged(own: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame, np.dtype]:
    """The different vectors at home, and routed; and the type of their values."""
    kind = np.dtype(np.float32 if own.schema["_values"].dataType.elementType == T.FloatType() else np.float64)
    pivots, counts = pivots_of(own)
    reps = own.groupBy("_one", "_two").agg(F.min("_vec").alias("_rep"), F.count("*").alias("copies"), F.any_value("_values").alias("_values"))
    homes = written(_homes(reps, pivots), "homes")
    layouts, first = {}, 0
    cells = homes.groupBy("n", "cell").agg(F.max("angle").alias("radius"), F.count("*").alias("size")).collect()  # a row for each pivot
    for n, p in pivots.items():
        radius, sizes = np.full(len(p), -math.inf), np.zeros(len(p), np.int64)
        for r in cells:
            if r.n == n:
                radius[r.cell], sizes[r.cell] = r.radius, r["size"]
        limit = max(min(max(LEAST_BLOCK, counts[n] // BLOCK_SHARE), MOST_BLOCK_VALUES // n), 1)
        layouts[n] = laid_out(p, radius, sizes, limit, first)
        first += int(layouts[n].blocks.sum())
    return homes, routed(homes, layouts, kind, cosine), kind


def linked(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    A vector that is null, empty or zero, or has null or non-finite components, has no link,
    nor has a row without a key, whose component is null. Vectors of different lengths aren't
    linked. Rows with one key are one node, with the most links that one of them has. Equal
    vectors are compared as one; cosines are those of double precision.
    """
    own = members(vectors, key, embedding)
    homes, blocks, kind = arranged(own, cosine)
    found = written(_compared(blocks, kind, cosine), "links")
    classes = own.groupBy("_one", "_two").agg(F.min("_vec").alias("_rep"))
    seat = written(own.select("_vec", "_one", "_two").join(classes, ["_one", "_two"]).select("_vec", "_rep"), "members")
    copies = seat.where("_vec <> _rep").select(F.col("_vec").alias("a"), F.col("_rep").alias("b"))
    joined = components(found.select("a", "b").union(copies)).withColumnRenamed("node", "_vec")
    counts = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "_rep")
    known = seat.join(counts, "_rep").groupBy("_vec").agg(F.max("links").alias("links")).join(joined, "_vec")
    out = vectors.select(F.col(key).cast("long").alias("_vec")).join(known, "_vec", "left")
    return out.select(F.col("_vec").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "_vec").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), components AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id::BIGINT AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, e.vec_id)::BIGINT AS component_id,
       coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
