"""Approximate nearest neighbours: vectors fall into cells, a query looks into the cells nearest to it.

Cells are those of spherical k-means, fitted on a bounded sample (``SAMPLE`` rows of
smallest hash); every vector is put into its cell. How many cells a query probes is
measured on the sample, so that the wanted share of its nearest is found: vectors
that lie in clusters take few probes, evenly spread ones many. What is in a probed
cell is scored exactly, so a row that is found has its right score.

A cell of many rows is several parts, which are scored apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.operators.vectors import _nearest, ranked
from loreweave.sources.shared import stored

SAMPLE, ROUNDS, TRIED = 20_000, 10, 300
#: Rows of a cell that are one part, and of a block.
PART, BLOCK = 1 << 16, 2048


@dataclass
class Quantiser:
    centroids: np.ndarray
    probes: int

    @property
    def cells(self) -> int:
        return len(self.centroids)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width))


def fine() -> Column:
    return F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def centroids(x: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit rows; a cell that loses all its rows takes the row that fits its own worst."""
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        score = x @ c.T
        own = score.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(score[np.arange(len(x)), own], kind="stable")[: len(empty)]]
        c = _unit(sums)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, recall: float, tried: int = TRIED) -> int:
    """The fewest cells in which rows of x find the share recall of their k nearest in x."""
    q = np.linspace(0, len(x) - 1, min(tried, len(x))).astype(int)
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(x[q] @ c.T), axis=1, kind="stable"), axis=1)
    at = np.take_along_axis(place, (x @ c.T).argmax(axis=1)[near], axis=1)
    found = np.array([(at < p).mean() if at.size else 1.0 for p in range(1, len(c) + 1)])
    return int(np.searchsorted(np.maximum.accumulate(found), min(recall, found[-1])) + 1)


def fit(vectors: DataFrame, k: int = 20, recall: float = 0.95, cells: int | None = None, sample: int = SAMPLE) -> Quantiser | None:
    """A quantiser of (id, embedding) rows of one width; None if there are none. cells: four times the root of the sample by default."""
    some = vectors.where(fine()).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow().column("embedding").combine_chunks()
    if isinstance(some, pa.ChunkedArray):
        some = some.chunk(0) if some.num_chunks else None
    if some is None or not len(some):
        return None
    x = _matrix(some, len(some[0]))
    c = centroids(x, cells or max(1, int(4 * np.sqrt(len(x)))))
    return Quantiser(c, probes_for(x, c, k, recall))


def _cells(shared, most: int):
    """The most nearest cells of each row."""

    def run(batches):
        c = shared.value
        for batch in batches:
            x = _matrix(batch.column("embedding"), c.shape[1])
            cells = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :most].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(cells.tolist(), pa.list_(pa.int32()))], ["id", "embedding", "cells"])

    return run


def _packed(batches):
    """Sorted rows (cell, part, id, embedding) as blocks of one cell and part."""
    for batch in batches:
        cell, part = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
        turn = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]))))
        for low, high in zip(turn, [*turn[1:], len(cell)], strict=True):
            for a in range(low, high, BLOCK):
                some = batch.slice(a, min(BLOCK, high - a))
                width = len(some.column("embedding")[0])
                ids = some.column("id").to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([cell[low]], pa.int32()), pa.array([part[low]], pa.int32()), pa.array([width], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([_matrix(some.column("embedding"), width).tobytes()], pa.binary())], ["cell", "part", "width", "ids", "rows"])


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "id").select("cell", "part", "id", "embedding").mapInArrow(_packed, "cell int, part int, width int, ids binary, rows binary")


def search(queries: DataFrame, vectors: DataFrame, quantiser: Quantiser | None, k: int = 20) -> DataFrame:
    """(query, id, score, rank): of the cells that each query probes the largest cosines, to six places, ties by id.

    queries and vectors: (id, embedding) of the quantiser's width; others, and null
    ids and entries, take no part. A row isn't its own neighbour.
    """
    spark = queries.sparkSession
    if quantiser is None:
        return spark.createDataFrame([], "query long, id long, score double, rank int")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(quantiser.centroids)  # a few thousand centroids
    width = quantiser.centroids.shape[1]
    ready = lambda df: df.where(fine() & (F.size("embedding") == width)).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = "id long, embedding array<double>, cells array<int>"
    placed = stored(ready(vectors).mapInArrow(_cells(shared, 1), kind).select("id", "embedding", F.col("cells")[0].alias("cell")), "cells")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # a row a cell
    dealt = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asked = ready(queries).mapInArrow(_cells(shared, quantiser.probes), kind).select("id", "embedding", F.explode("cells").alias("cell"))
    asked = asked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    q = _blocks(asked, n).select("cell", "part", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    met = _blocks(dealt, n).join(q, ["cell", "part"]).select("width", "ids", "rows", "q_ids", "q_rows")
    found = met.mapInArrow(_nearest(k), "query long, id long, score double")
    return ranked(found, ["query"], [F.col("score").desc(), F.col("id")], k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (recall, n): which share of the exact (query, id) rows was found, and how many there are."""
    hit = exact.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n"))
