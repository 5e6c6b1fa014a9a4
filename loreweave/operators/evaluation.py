"""Retrieval quality: metrics of ranked results against expected ones."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loreweave.operators.vectors import ranked


def metrics(results: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(query, k, hit, recall, mrr, precision) of results (query, id, rank) against expected (query, id).

    Every query of expected counts, found or not. Recall is over distinct
    expected ids; precision divides by k even if there are fewer results.
    """
    want = expected.select("query", "id").distinct()
    n = want.groupBy("query").agg(F.count("*").alias("n"))
    good = results.join(want, ["query", "id"])
    at = F.explode(F.array(*map(F.lit, ks))).alias("k")
    found = good.select("query", "id", "rank", at).where("rank <= k").groupBy("query", "k").agg(F.count_distinct("id").alias("found"), F.min("rank").alias("first"), F.count("*").alias("hits"))
    grid = n.select("query", "n", at)
    out = grid.join(found, ["query", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("query", "k", F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"), zero(F.col("found") / F.col("n")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("hits") / F.col("k")).alias("precision"))


def means(per_query: DataFrame) -> DataFrame:
    """(k, metric means, n) over queries."""
    return per_query.groupBy("k").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr", "precision")], F.count("*").alias("n"))


def timings(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, least, most, mean, n) of measured values."""
    return rows.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))


def backfilled(questions: DataFrame, results: DataFrame) -> DataFrame:
    """(query, sources): the distinct sources of results (text, pos, source) of a question's very text, in order; none: an empty list.

    Null texts meet nothing.
    """
    first = results.where("source is not null").groupBy("text", "source").agg(F.min("pos").alias("pos"))
    listed = first.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "source"))), lambda x: x["source"]).alias("sources"))
    return questions.join(listed, "text", "left").select("query", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def totals(runs: DataFrame) -> DataFrame:
    """(n, failed, mean_ms) of (query, error, ms) rows, one row: failed ones count in n and in the mean."""
    return runs.agg(F.count("*").alias("n"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"), (F.coalesce(F.sum("ms"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("mean_ms"))


def markdown_report(summary: DataFrame) -> str:
    """A summary of a few rows (one per k) as a Markdown table."""
    names = summary.columns
    rows = [[str(r[c]) for c in names] for r in summary.orderBy(names[0]).collect()]  # a row for each k
    return "\n".join("| " + " | ".join(x) + " |" for x in [names, ["---"] * len(names), *rows]) + "\n"


# --- runs that outlive a bad question


def isolated(rows: DataFrame, columns: Sequence[str], score: Callable[..., float]) -> DataFrame:
    """(query, id, score, error, ms) of rows (query, id, ...): a Python function of some columns, row by row.

    What it raises is the row's error ('KeyError: ...', 300 characters at most) and
    its score null; other rows are scored. Nulls come as None.
    """
    kinds = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            out = []
            for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                began = time.perf_counter()
                try:
                    out.append((float(score(*values)), None))
                except Exception as e:  # whatever a provider does
                    out.append((None, f"{type(e).__name__}: {e}"[:300]))
                out[-1] += ((time.perf_counter() - began) * 1e3,)
            found = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.float64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), *found], ["query", "id", "score", "error", "ms"])

    wanted = list(dict.fromkeys(["query", "id", *columns]))
    return rows.select(*wanted).mapInArrow(run, f"query {kinds['query']}, id {kinds['id']}, score double, error string, ms double")


def run(scored: DataFrame, expected: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> tuple[DataFrame, DataFrame]:
    """(metrics of the queries without an error, (query, error, failed) of the others) of scored (query, id, score, error).

    A query fails as a whole if any of its rows did; error: the least of its
    messages, failed: how many of its rows. Ties of scores go by id.
    """
    bad = scored.where("error is not null").groupBy("query").agg(F.min("error").alias("error"), F.count("*").alias("failed"))
    good = scored.join(bad.select("query"), "query", "left_anti")
    results = ranked(good, ["query"], [F.col("score").desc(), F.col("id")], max(ks))
    return metrics(results.select("query", "id", "rank"), expected.join(bad.select("query"), "query", "left_anti"), ks), bad


class Counters:
    """Counts of what passes the stages of a plan, taken while it runs once; no pass of their own."""

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def at(self, stage: str, df: DataFrame, **counts: Column) -> DataFrame:
        """df, whose rows are counted when an action runs over it; counts: aggregates besides n. A stage is named once."""
        if stage in self._seen:
            raise ValueError(f"stage {stage} is there already")
        self._seen[stage] = Observation(stage)
        return df.observe(self._seen[stage], F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in counts.items()])

    def values(self) -> dict[str, dict]:
        """By stage its counts, once an action has run over all of them; waits for it."""
        return {stage: dict(seen.get) for stage, seen in self._seen.items()}
