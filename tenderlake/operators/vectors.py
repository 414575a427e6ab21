"""Vectors in blocks: an inverted file for nearest neighbours, and an exact join of pairs above a cosine.

Both compare blocks of vectors by a matrix product in Arrow batches; no block holds more than a fixed number of vectors, however many
share a cell, a day or a direction.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.storage import written

#: Vectors that the centres are fitted on, rounds of fitting, and the most centres.
SAMPLE, ROUNDS, CELLS = 16_384, 12, 1024
#: Vectors, and queries, of a block.
BLOCK, ASKED = 1024, 256
#: Queries that the number of probed cells is set by.
TRIED = 64
#: Vectors of a block of the join of close pairs, and cosines that are held at once. A block meets each other one of its slots, so that
#: the bytes moved fall as blocks grow.
JOINED, HELD = 16_384, 1 << 22


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def directed(vectors: DataFrame, dims: int, *, id: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, v): vectors of ``dims`` numbers that have a direction. A null, empty, zero, longer, shorter or unbounded one has none and
    is near nothing."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == dims)
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < 1e150)), F.lit(False))
    return rows.filter(finite & F.exists("v", lambda x: F.abs(x) > 1e-150))


def fitted_centres(rows: DataFrame, dims: int, cells: int | None = None) -> np.ndarray:
    """Unit centres of (id, v), by spherical k-means over the ``SAMPLE`` vectors of least hash: as many as the root of the
    rows, CELLS at most. Any centres give right cells; good ones give few probes."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    few = rows.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 40)) < int(share * (1 << 40))).select("v").distinct().limit(2 * SAMPLE)
    x = few.toArrow().column("v").combine_chunks()
    if not len(x):
        return np.zeros((1, dims))
    x = _unit(_matrix(x))
    x = x[np.lexsort(x.T[::-1])]  # in an order of its own, whatever order the rows came in
    k = min(cells or math.isqrt(n), CELLS, max(1, len(x) // 8))
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        full = np.linalg.norm(sums, axis=1) > 1e-12
        centres[full] = _unit(sums[full])
    return centres


def celled(rows: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """``rows`` with cells: the numbers of the ``probes`` nearest centres, nearest first."""
    ship(rows.sparkSession)
    held = rows.sparkSession.sparkContext.broadcast(centres)
    most = min(probes, len(centres))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cells array<int>"

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            score = _unit(_matrix(batch.column("v"))) @ held.value.T
            near = np.argsort(-score, axis=1, kind="stable")[:, :most].astype(np.int32)
            cells = pa.ListArray.from_arrays(np.arange(0, near.size + 1, most, dtype=np.int32), near.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(run, fields)


def _blocks(rows: DataFrame, key: list[str], keep: list[str], most: int) -> DataFrame:
    """A row per block of at most about ``most`` rows of a key, dealt by the hash of the id: key, block, held."""
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"_k_{c}") for c in key], F.ceil(F.col("_n") / most).alias("_n"))
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key]
    dealt = rows.join(sizes, on).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_n")))
    return dealt.groupBy(*key, "block").agg(F.collect_list(F.struct(*keep)).alias("held"))


class VectorIndex:
    """X-03. An inverted file: each vector lies in the cell of its nearest centre, and a query looks into some cells only.

    Every vector that has a direction is in it; the centres come from a bounded sample. Scores are exact cosines.
    """

    def __init__(self, vectors: DataFrame, dims: int, cells: int | None = None):
        rows = directed(vectors, dims)
        self.dims, self.centres = dims, fitted_centres(rows, dims, cells)
        self.rows = written(celled(rows, self.centres).select("id", "v", F.element_at("cells", 1).alias("cell")), "cells")
        self.blocks = written(_blocks(self.rows, ["cell"], ["id", "v"], BLOCK).select("cell", "held"), "blocks")

    def _met(self, queries: DataFrame, probes: int, k: int, extra: bool) -> DataFrame:
        """(query, id, score, cell): the k best of each query in each block that it meets."""
        asked = celled(directed(queries, self.dims, id="query", vector="vector"), self.centres, probes)
        asked = _blocks(asked.select("id", "v", F.explode("cells").alias("cell")), ["cell"], ["id", "v"], ASKED).select("cell", F.col("held").alias("asked"))
        kind = self.rows.schema["id"].dataType.simpleString()
        query_kind = queries.schema["query"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                for cell, held, asked in zip(*[batch.column(c) for c in ("cell", "held", "asked")], strict=True):
                    ids, v = held.values.field("id"), _unit(_matrix(held.values.field("v")))
                    queries, q = asked.values.field("id"), _unit(_matrix(asked.values.field("v")))
                    score = np.clip(q @ v.T, -1, 1)
                    # Blocks hold some hundred vectors: order by score, then by the id's place among sorted ids.
                    place = np.argsort(np.argsort(np.array(ids.to_pylist(), dtype=object), kind="stable"), kind="stable")
                    rounded = np.round(score, 5)
                    best = np.lexsort((np.broadcast_to(place, score.shape), -rounded), axis=1)[:, :k]
                    row = np.repeat(np.arange(len(q)), best.shape[1])
                    flat = best.ravel()
                    yield pa.RecordBatch.from_arrays(
                        [queries.take(pa.array(row)), ids.take(pa.array(flat)), pa.array(rounded[row, flat]), pa.array(np.full(len(flat), cell.as_py(), np.int32)), pa.array(np.full(len(flat), len(ids), np.int64))],
                        names=["query", "id", "score", "cell", "compared"],
                    )

        joined = self.blocks.join(asked, "cell")
        out = joined.mapInArrow(run, f"query {query_kind}, id {kind}, score double, cell int, compared long")
        return out if extra else out.select("query", "id", "score")

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, id, score, rank): the k nearest vectors of each query (query, vector) in the ``probes`` cells nearest to it."""
        from .search import top

        return top(self._met(queries, probes, k, False), k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """How many cells a query has to look into for this recall at k: for ``TRIED`` of the queries the exact neighbours are
        found in all cells, and the place of a neighbour's cell among its query's cells says how many it takes."""
        few = queries.orderBy(F.xxhash64("query"), "query").limit(TRIED)
        exact = self._met(few, len(self.centres), k, True)
        from .search import top

        exact = top(exact, k).select("query", "cell")
        cells = celled(directed(few, self.dims, id="query", vector="vector"), self.centres, len(self.centres)).select(F.col("id").alias("query"), "cells")
        places = sorted(r.p for r in exact.join(cells, "query").select(F.array_position("cells", F.col("cell")).alias("p")).collect())
        return int(places[min(len(places) - 1, math.ceil(recall * len(places)))]) if places else 1

    def compared(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query, compared): the vectors that each query is compared with."""
        sizes = self.rows.groupBy("cell").count()
        asked = celled(directed(queries, self.dims, id="query", vector="vector"), self.centres, probes).select(F.col("id").alias("query"), F.explode("cells").alias("cell"))
        return asked.join(sizes, "cell").groupBy("query").agg(F.sum("count").alias("compared"))


def close_pairs(rows: DataFrame, least: float, seconds: int, *, dims: int, others: DataFrame | None = None, every: bool = False) -> DataFrame:
    """(a, b) of rows (id, k, at, embedding): pairs a < b of one key, at most ``seconds`` apart, with a cosine of ``least`` or more;
    with ``others``, pairs of a row and one of those instead. With ``every`` all such pairs, those of copies too, each once;
    else links that connect the same rows as these do:

    Exact. Equal vectors of a key and a slot of that width are one class: all are linked to the smallest id, and only the
    earliest and the latest, which see every other row that any of them sees, go on. Those lie in blocks of JOINED by key and
    slot, which meet those of the same and the neighbouring slots. Within two blocks the parts of a cell, each with a centre and
    a radius, are multiplied only if their balls can hold two vectors so near (the triangle inequality). So copies and far
    directions make no pairs, and what is moved is a block for each JOINED rows that a block can meet.
    """
    ship(rows.sparkSession)
    given = rows.withColumn("new", F.lit(True))
    given = given if others is None else given.select("id", "k", "at", "embedding", "new").unionByName(others.select("id", "k", "at", "embedding", F.lit(False).alias("new")))
    given = given.filter("at is not null and k is not null")
    # An id may be on both sides.
    v = directed(given.select(F.struct("id", "new").alias("id"), "embedding"), dims)
    placed = given.select(F.struct("id", "new").alias("id"), "k", "at", "new").join(v.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).drop("_i")
    placed = written(placed.withColumn("slot", F.floor(F.unix_seconds("at") / seconds)).withColumn("h", F.xxhash64("v")), "placed")
    same = ("k", "slot", "new", "h", "v")
    centres = fitted_centres(placed.select("id", "v"), dims)
    kinds = placed.groupBy(*same).agg(F.min("id").alias("first"), F.min_by("id", F.struct("at", "id")).alias("early"), F.max_by("id", F.struct("at", "id")).alias("late"))
    ends = kinds.select(F.explode(F.array_distinct(F.array("early", "late"))).alias("_e"))
    few = placed if every else placed.join(ends, F.col("id") == F.col("_e"), "left_semi")
    few = few.select("id", "k", "slot", "new", F.unix_micros("at").alias("t"), "v")
    few = celled(few, centres).select(F.col("id.id").alias("id"), "k", "slot", "new", "t", F.col("v").cast(given.schema["embedding"].dataType).alias("v"), F.element_at("cells", 1).alias("cell"))
    blocks = written(_blocks(few, ["k", "slot", "new"], ["id", "t", "v", "cell"], JOINED).withColumn("n", F.monotonically_increasing_id()), "blocks")
    one = blocks.select("n", "k", "slot", "new").filter("new")
    other = blocks.select(F.col("n").alias("m"), F.col("k").alias("_k"), F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("_slot"), F.col("new").alias("_new"))
    met = one.join(other, (F.col("k") == F.col("_k")) & (F.col("slot") == F.col("_slot"))).filter((F.col("m") <= F.col("n")) & F.col("_new") if others is None else ~F.col("_new"))
    held = met.select("n", "m").join(blocks.select("n", "held"), "n").join(blocks.select(F.col("n").alias("m"), F.col("held").alias("asked")), "m").select("held", "asked", (F.col("n") == F.col("m")).alias("same"))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for held, asked, itself in zip(*[batch.column(c) for c in ("held", "asked", "same")], strict=True):
                x, y = Balls(held.values), Balls(asked.values)
                for at, i in enumerate(x.parts):
                    # Parts whose balls can hold two vectors so near, in slices of a bounded product.
                    other = np.flatnonzero(np.linalg.norm(y.centre - x.centre[at], axis=1) <= y.radius + x.radius[at] + reach)
                    if not len(other):
                        continue
                    columns = np.concatenate([np.arange(y.parts[j].start, y.parts[j].stop) for j in other])
                    for start in range(0, len(columns), HELD // BLOCK):
                        j = columns[start : start + HELD // BLOCK]
                        a, b = np.nonzero(x.unit[i] @ y.unit[j].T >= least - 1e-12)
                        a, b = a + i.start, j[b]
                        near = np.abs(x.t[a] - y.t[b]) <= seconds * 1_000_000
                        if itself.as_py():
                            near &= a < b
                        yield pa.RecordBatch.from_arrays([x.id.take(pa.array(a[near])), y.id.take(pa.array(b[near]))], names=["a", "b"])

    found = held.mapInArrow(run, f"a {kind}, b {kind}")
    if every:
        return found if others is not None else found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    if others is not None:
        # Each copy of a row meets the others through the first or the last of its class.
        return found.distinct()
    on = [placed[c].eqNullSafe(kinds[c]) for c in same]
    copies = placed.join(kinds.select(*same, "first"), on).select(F.col("first.id").alias("a"), placed["id.id"].alias("b")).filter("a < b")
    return copies.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")).distinct()


class Balls:
    """Vectors of a block in order of their cells, in parts of at most BLOCK of one cell: each with the mean of its unit vectors and
    the greatest distance from it."""

    def __init__(self, held: pa.StructArray):
        cell = held.field("cell").to_numpy()
        held = held.take(pa.array(np.argsort(cell, kind="stable")))
        cell = np.sort(cell)
        self.id, self.t, self.unit = held.field("id"), held.field("t").to_numpy(), _unit(_matrix(held.field("v")))
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]).tolist()
        self.parts = [slice(i, min(i + BLOCK, end)) for start, end in zip(starts, [*starts[1:], len(cell)], strict=True) for i in range(start, end, BLOCK)]
        self.centre = np.stack([self.unit[p].mean(0) for p in self.parts])
        self.radius = np.array([np.linalg.norm(self.unit[p] - c, axis=1).max() for p, c in zip(self.parts, self.centre, strict=True)])
