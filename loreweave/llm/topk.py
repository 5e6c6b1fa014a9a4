"""Exact top-k inner products by Fagin's threshold algorithm, block against block.

Vectors are packed in blocks. A task that holds a block has, for each dimension,
its vectors sorted by that component; a query walks the 64 lists from the end
that its own component's sign favours. Every vector met is scored in full. The
bound of what is still unseen is the query against the components where the
lists stand; once it is below the k-th score (equal would leave ties open), the
block is done. The k-th score so far carries over from block to block, so a block
may end before its first step.

Queries also travel in blocks. Blocks of vectors are dealt to the rows of a grid
and blocks of queries to its columns; a task has one cell, so a vector moves once
for each column and a query once for each row. A column has a bounded number of
queries, which a task holds while the vectors pass.

Components that would leave the range in which sums of products of doubles are
exact are scored as Python integers; their blocks are kept apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import partitions, stored

BLOCK, QUERIES = 4096, 512
#: Blocks of queries that a task holds.
COLUMN = 64
LONG = 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) as doubles; vectors that are null or hold null or non-finite components (times scale) are gone."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda y: y.isNotNull() & ~F.isnan(y.cast("double")) & (F.abs(y.cast("double") * scale) != float("inf")))
    floored = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # noqa: E731 - larger doubles are whole
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda y: floored(y.cast("double") * scale)).alias("v"))


def exact(x: np.ndarray) -> np.ndarray:
    """Of rows, whether inner products with rows like them are exact in doubles."""
    return np.abs(x).max(axis=1, initial=0.0) ** 2 * max(1, x.shape[1]) < 2.0**53


BLOCK_SQL = "width int, big boolean, rids binary, ids binary, rows binary"


def _pack(size: int):
    """Rows of (rid, vec_id, v) in blocks of one width; rows with large components in blocks of their own."""

    def run(batches):
        rids, ids, rows = [], [], []

        def out():
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(rows):
                by_width.setdefault(len(v), []).append(i)
            for width, own in by_width.items():
                body = np.array([rows[i] for i in own], np.float64).reshape(len(own), width)
                fine = exact(body)
                for big in (False, True):
                    some = np.flatnonzero(fine != big)
                    for low in range(0, len(some), size):
                        at = some[low : low + size]
                        values = (np.array([x[own[i]] for i in at.tolist()], np.int64).tobytes() for x in (rids, ids))
                        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([big]), *(pa.array([x], pa.binary()) for x in (*values, body[at].tobytes()))], [x.split()[0] for x in BLOCK_SQL.split(", ")])
            for x in (rids, ids, rows):
                x.clear()

        for batch in batches:
            column = batch.column("v")
            flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
            rids += batch.column("rid").to_pylist()
            ids += batch.column("vec_id").to_pylist()
            rows += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            if len(rows) >= 8 * size:
                yield from out()
        if rows:
            yield from out()

    return run


class Lists:
    """A block's vectors, sorted along each dimension."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rids, self.ids, self.rows = rids[order], ids[order], rows[order]
        self.up = np.argsort(self.rows, axis=0, kind="stable").T.copy()  # dimensions x vectors
        self.sorted = np.take_along_axis(self.rows.T, self.up, axis=1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> list[list[tuple[float, int]]]:
        """The (score, id) best k of each query, its own row (of rid own) left out; kth: scores that must be reached."""
        n = len(self.ids)
        signs = queries >= 0
        steps = [0]
        while steps[-1] < n:
            steps.append(min(n, max(n // 64, 4, 2 * steps[-1])))
        # bounds[s][q]: best possible score of a vector not among the first steps[s] of any list
        plus, minus = np.where(signs, queries, 0), np.where(signs, 0, queries)
        bounds = [plus @ self.sorted[:, n - 1 - t] + minus @ self.sorted[:, t] for t in steps[:-1]]
        out = []
        for q in range(len(queries)):
            met, best, least = np.zeros(n, bool), [], kth[q]
            up, down = self.up[~signs[q]], self.up[signs[q]]
            for s, t in enumerate(steps[:-1]):
                if bounds[s][q] < least:
                    break
                reach = np.zeros(n, bool)
                reach[up[:, t : steps[s + 1]]] = True
                reach[down[:, n - steps[s + 1] : n - t]] = True
                if not queries.shape[1]:  # no lists to walk
                    reach[t : steps[s + 1]] = True
                new = np.flatnonzero(reach & ~met)
                met |= reach
                score = self.rows[new] @ queries[q]
                fine = np.flatnonzero((score >= least) & (self.rids[new] != own[q]))
                if len(fine):
                    ids, score = self.ids[new[fine]], score[fine]
                    first = np.lexsort((ids, -score))[:k]
                    best = sorted([*best, *zip((-score[first]).tolist(), ids[first].tolist(), strict=True)])[:k]
                    if len(best) == k:
                        least = max(least, -best[-1][0])
            out.append([(-a, b) for a, b in best])
        return out


def whole_scores(rids: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """As Lists.search, every vector scored with integers of any size."""
    integers = lambda x: np.array([[int(y) for y in v] for v in x.tolist()], object).reshape(x.shape)
    body, out = integers(rows), []
    for q, mine in zip(integers(queries), own.tolist(), strict=True):
        score = body @ q if len(q) else np.zeros(len(body), np.int64)
        out.append([(s, i) for s, i in sorted(((int(s), i) for s, i, r in zip(score.tolist(), ids.tolist(), rids.tolist(), strict=True) if r != mine), key=lambda x: (-x[0], x[1]))[:k]])
    return out


FOUND_SQL = "query long, query_id long, vec_id long, leading long, whole binary, score long"


def _search(k: int):
    """A cell: its blocks of queries (kind 0) come first and are held, then the blocks of vectors pass."""

    def run(batches):
        held: list[tuple] = []
        cell = None
        for batch in batches:
            for at, kind, *row in zip(*(batch.column(x).to_pylist() for x in ("cell", "kind", "width", "big", "rids", "ids", "rows")), strict=True):
                if at != cell:
                    cell, held = at, []
                width, big = row[:2]
                rids, ids = (np.frombuffer(x, np.int64) for x in row[2:4])
                body = np.frombuffer(row[4], np.float64).reshape(len(ids), width)
                if kind == 0:
                    held.append((width, big, rids, ids, body, np.full(len(ids), -np.inf)))
                    continue
                lists = None
                for q_width, q_big, q_rids, q_ids, queries, least in held:
                    if q_width != width:
                        continue
                    if big or q_big:
                        found = whole_scores(rids, ids, body, queries, q_rids, k)
                    else:
                        lists = lists or Lists(rids, ids, body)
                        found = lists.search(queries, q_rids, k, least)
                        for i, x in enumerate(found):
                            if len(x) == k:
                                least[i] = max(least[i], x[-1][0])
                    out = [(int(q_rids[i]), int(q_ids[i]), v, *_ranks(int(s))) for i, x in enumerate(found) for s, v in x]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if isinstance(x[0], bytes) else pa.int64()) for x in zip(*out, strict=True)], [x.split()[0] for x in FOUND_SQL.split(", ")])

    return run


def _ranks(score: int) -> tuple[int, bytes, int]:
    """(leading, all, near) that sort as scores do: near is the nearest long; the others matter beyond the range of longs."""
    near = max(-LONG, min(LONG, score))
    rest = abs(score - near)
    size = rest.bit_length()
    lead = rest if size <= 50 else (size << 50) + (rest >> (size - 50))
    return (lead if score > 0 else -lead), ((score + (1 << 2300)).to_bytes(288, "big") if rest else b""), near


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best inner products of each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by every; candidates all other
    rows, also those of the same vec_id. Null vec_id, null vectors and those with
    null or non-finite components (times scale) take no part. Vectors meet those of their own
    width. Empty vectors score 0. Rows that repeat a vec_id: each is a row, as
    query and as candidate. Scores beyond the range of longs: in order, and given
    as the nearest long. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = stored(quantised(vectors, scale).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    held = stored(rows.select("rid", "vec_id", "v").mapInArrow(_pack(BLOCK), BLOCK_SQL).withColumn("b", F.monotonically_increasing_id()), "vector-blocks")
    some = rows.where(F.col("vec_id") % every == 0).select("rid", "vec_id", "v")
    asked = stored(some.coalesce(max(1, n // 8)).mapInArrow(_pack(QUERIES), BLOCK_SQL).withColumn("b", F.monotonically_increasing_id()), "query-blocks")
    columns = max(1, -(-asked.count() // COLUMN))
    lines = max(1, min(held.count(), -(-4 * n // columns)))
    deal = lambda m: F.pmod(F.xxhash64("b"), F.lit(m))
    # Each block of vectors goes to a line of the grid, in all its columns; each of queries the other way.
    left = held.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: (deal(lines) * columns + c).cast("int")))).withColumn("kind", F.lit(1))
    right = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda r: (r * columns + deal(columns)).cast("int")))).withColumn("kind", F.lit(0))
    work = right.unionByName(left).repartitionById(lines * columns, F.col("cell")).sortWithinPartitions("cell", "kind", "b")
    found = work.select("cell", "kind", "width", "big", "rids", "ids", "rows").mapInArrow(_search(k), FOUND_SQL)
    order = Window.partitionBy("query").orderBy(F.col("leading").desc(), F.col("whole").desc(), F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6(vectors: DataFrame) -> DataFrame:
    return top_k(vectors)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
