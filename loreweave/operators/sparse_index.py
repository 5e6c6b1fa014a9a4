"""Exact top-k over sparse vectors without a join on terms.

Documents are dealt out by their id, never by term, so no key has all of them. A
task holds a block of queries, takes its documents in segments of bounded size and
builds for each an inverted index whose postings stand by falling weight. A query
takes blocks of postings where its weight times the next posting's is large, scores
the documents it meets in full, and leaves the segment once what the next postings
could add up to is below its k-th score. That score carries over to later segments.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.sources.shared import stored

#: Postings of a segment, queries that a task holds, postings of the first block taken of a term.
SEGMENT, HELD, BLOCK = 1 << 21, 4096, 32
PLACES = 6


class Segment:
    """An inverted index over documents given as (ids, starts, terms, weights), with what it takes to score one in full."""

    def __init__(self, ids: pa.Array, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ids, self.starts, self.terms, self.weights = ids, starts, terms, weights
        n = len(starts) - 1
        place = np.empty(n, np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(n)
        self.place = place  # of an id among the segment's, for ties
        doc = np.repeat(np.arange(n), np.diff(starts))
        order = np.lexsort((doc, -weights, terms))
        self.doc, self.weight = doc[order], weights[order]
        self.known, first = np.unique(terms[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.size = int(terms.max(initial=-1)) + 1
        self.scored = 0

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Whole scores of docs; dense: the query's weight of each term."""
        size = self.starts[docs + 1] - self.starts[docs]
        at = np.repeat(self.starts[docs] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        self.scored += int((dense[self.terms[at]] != 0).sum())
        return np.bincount(np.repeat(np.arange(len(docs)), size), weights=dense[self.terms[at]] * self.weights[at], minlength=len(docs))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best that share a term, by score (to six places) and id; below least none is needed. Weights are positive."""
        at = np.searchsorted(self.known, terms)
        fine = at < len(self.known)
        fine[fine] = self.known[at[fine]] == terms[fine]
        at, terms, weights = at[fine], terms[fine], weights[fine]
        dense = np.zeros(self.size + 1)
        dense[terms] = weights
        cursor, end = self.bounds[at].copy(), self.bounds[at + 1]
        seen = np.zeros(len(self.starts) - 1, bool)
        found, best = np.zeros(0, np.int64), np.zeros(0)
        block = BLOCK
        while True:
            open_ = cursor < end
            ahead = np.where(open_, weights * self.weight[np.minimum(cursor, len(self.weight) - 1)], 0.0)
            if not open_.any() or ahead.sum() + 10.0**-PLACES < least:
                break
            # The terms that bring most, so that the bound falls fast.
            taken = np.flatnonzero(open_ & (ahead >= 0.5 * ahead.max()))
            high = np.minimum(cursor[taken] + block, end[taken])
            new = np.unique(np.concatenate([self.doc[a:b] for a, b in zip(cursor[taken], high, strict=True)]))
            cursor[taken] = high
            block *= 2
            new = new[~seen[new]]
            seen[new] = True
            if len(new):
                score = self.scores(new, dense)
                own = np.round(score, PLACES) >= least
                found, best = np.concatenate((found, new[own])), np.concatenate((best, score[own]))
                order = np.lexsort((self.place[found], -np.round(best, PLACES)))[:k]
                found, best = found[order], best[order]
                if len(best) == k:
                    least = max(least, float(np.round(best[-1], PLACES)))
        return found, best


def _lists(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _search(k: int, segment: int, query_type: pa.DataType, id_type: pa.DataType):
    """A task's cells: the queries (kind 0) come first and are held, documents pass in segments."""

    def run(batches):
        asked: list[list] = []
        parts: list[pa.RecordBatch] = []
        held = 0
        cell = None

        def answers():
            terms, size = (np.concatenate(x) for x in zip(*(_lists(p.column("terms"), np.int64) for p in parts), strict=True))
            weights = np.concatenate([_lists(p.column("weights"), np.float64)[0] for p in parts])
            ids = pa.concat_arrays([p.column("id") for p in parts])
            index = Segment(ids, np.concatenate(([0], np.cumsum(size))), terms, weights)
            for own in asked:
                docs, scores = index.search(own[1], own[2], k, own[3][0] if len(own[3]) == k else -np.inf)
                if len(docs):
                    own[3] = np.sort(np.concatenate((own[3], np.round(scores, PLACES))))[-k:]
                    yield pa.RecordBatch.from_arrays([pa.array([own[0]] * len(docs), query_type), ids.take(pa.array(docs)).cast(id_type), pa.array(scores)], ["query", "id", "score"])
            parts.clear()

        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            turn = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]))))
            for low, high in zip(turn, [*turn[1:], batch.num_rows], strict=True):
                some = batch.slice(low, high - low)
                if cells[low] != cell:
                    if parts:
                        yield from answers()
                    cell, asked, held = cells[low], [], 0
                if kinds[low] == 0:
                    terms, size = _lists(some.column("terms"), np.int64)
                    weights, at = _lists(some.column("weights"), np.float64)[0], np.concatenate(([0], np.cumsum(size)))
                    asked += [[q, terms[a:b], weights[a:b], np.zeros(0)] for q, a, b in zip(some.column("query").to_pylist(), at[:-1], at[1:], strict=True)]
                    continue
                sizes = some.column("terms").value_lengths().to_numpy(zero_copy_only=False)
                start = 0
                while start < some.num_rows:
                    room = np.searchsorted(np.cumsum(sizes[start:]), max(0, segment - held), "right")
                    until = min(some.num_rows, start + max(int(room), 0 if held else 1))
                    if until > start:
                        parts.append(some.slice(start, until - start))
                        held += int(sizes[start:until].sum())
                    if until < some.num_rows:
                        yield from answers()
                        held = 0
                    start = until
        if parts:
            yield from answers()

    return run


def top_rows(queries: DataFrame, docs: DataFrame, k: int, segment: int = SEGMENT, most_held: int = HELD) -> DataFrame:
    """(query, id, score): of each part of the documents the k best of each query, ties to six places by id.

    queries and docs: sparse vectors (id, index, weight) with positive weights; docs
    may be packed, a row (id, terms, weights) each. Null ids take no part. A query
    moves once to each row of a grid of tasks, a document once to each column; one
    column has most_held queries.
    """
    spark = queries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def packed(df: DataFrame) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("index", F.col("weight").cast("double").alias("weight"))))
        return df.where(F.col("id").isNotNull()).groupBy("id").agg(own.alias("v")).select("id", F.col("v.index").cast("array<long>").alias("terms"), F.col("v.weight").alias("weights"))

    asked = stored(packed(queries), "asked")
    columns = max(1, -(-asked.count() // most_held))
    lines = max(1, n // columns)
    deal = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
    q_type, d_type = queries.schema["id"].dataType, docs.schema["id"].dataType
    rows = docs.where(F.col("id").isNotNull()) if "terms" in docs.columns else packed(docs)
    left = rows.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: (deal(lines) * columns + c).cast("int"))))
    left = left.select("cell", F.lit(1).alias("kind"), F.lit(None).cast(q_type).alias("query"), "id", "terms", "weights")
    right = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda r: (r * columns + deal(columns)).cast("int"))))
    right = right.select("cell", F.lit(0).alias("kind"), F.col("id").alias("query"), F.lit(None).cast(d_type).alias("id"), "terms", "weights")
    work = right.unionByName(left).repartitionById(lines * columns, F.col("cell")).sortWithinPartitions("cell", "kind")
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"query {q_type.simpleString()}, id {d_type.simpleString()}, score double"
    return work.mapInArrow(_search(k, segment, to_arrow_type(q_type), to_arrow_type(d_type)), schema)
