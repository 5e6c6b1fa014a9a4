"""Greedy selection as a fold: rows of a query in order, each taken or passed over by what was taken before.

A query's rows are one sorted array (a bounded list of candidates); the fold is
Spark's ``aggregate`` over it, with the rows taken so far as its state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whether a row x is taken when those in picked are, out of all rows of the query: (picked, x, all) -> boolean.
Rule = Callable[[Column, Column, Column], Column]


def chosen(rows: DataFrame, fields: Sequence[str], rules: Sequence[Rule], pool: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query, id, rank): rows (query, id, pos and fields) that the rules take, in the order in which they do.

    Each rule goes once through the query's rows by pos and id, after the rule
    before it; pool: which rows (an array) take part at all. A query of which none
    is taken has no rows.
    """
    lists = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "id", *fields))).alias("all"))
    if pool is not None:
        lists = lists.withColumn("all", pool(F.col("all")))

    def step(rule: Rule) -> Callable[[Column, Column], Column]:
        return lambda picked, x: F.when(rule(picked, x, F.col("all")), F.array_append(picked, x)).otherwise(picked)

    picked = F.filter("all", lambda x: F.lit(False))
    for rule in rules:
        picked = F.aggregate("all", picked, step(rule))
    taken = lists.select("query", F.posexplode(picked).alias("at", "x"))
    return taken.select("query", F.col("x.id").alias("id"), (F.col("at") + 1).cast("int").alias("rank"))


def among(picked: Column, what: Callable[[Column], Column]) -> Column:
    """How many of the picked rows fit."""
    return F.size(F.filter(picked, what))


def total(picked: Column, field: str) -> Column:
    return F.aggregate(picked, F.lit(0).cast("long"), lambda acc, x: acc + x[field])
