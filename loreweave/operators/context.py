"""Context assembly: budgets, packages, merging and greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import normalized, token_estimate
from loreweave.operators import folds


def compress(rows: DataFrame, most_tokens: int = 4000, least_rest: int = 100) -> DataFrame:
    """Rows of (query, id, pos, content) within a token budget, in order; ends at the first that overflows.

    Of that one a part stays if over least_rest tokens are left for it. Of equal
    ids the first counts. tokens: of what stays.
    """
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query", "id").orderBy("pos"))).where("nth = 1").drop("nth")
    own = token_estimate("content")
    order = Window.partitionBy("query").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = once.withColumn("upto", F.sum(own).over(order))
    first = F.min(F.when(F.col("upto") > most_tokens, F.col("pos"))).over(Window.partitionBy("query"))
    run = run.withColumn("over", first).withColumn("rest", F.lit(most_tokens) - (F.col("upto") - own))
    kept = run.where(F.col("over").isNull() | (F.col("pos") < F.col("over")) | ((F.col("pos") == F.col("over")) & (F.col("rest") > least_rest)))
    content = F.when(F.col("pos") == F.col("over"), F.left("content", (F.col("rest") * 4).cast("int"))).otherwise(F.col("content"))
    return kept.withColumn("content", content).withColumn("tokens", token_estimate("content")).drop("upto", "over", "rest")


def package(rows: DataFrame, entry: Column, most_tokens: int = 4000) -> DataFrame:
    """(query, n, token_estimate, text) of (query, pos) rows: entries in order, up to the one that reaches the budget, it included."""
    order = Window.partitionBy("query").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("entry", entry).withColumn("own", token_estimate("entry")).withColumn("upto", F.sum("own").over(order))
    kept = run.where(F.col("upto") - F.col("own") < most_tokens)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda x: x["entry"]), "\n")
    return kept.groupBy("query").agg(F.count("*").alias("n"), F.sum("own").alias("token_estimate"), text.alias("text"))


def scoped_package(rows: DataFrame, entry: Column, most_tokens: int = 4000) -> DataFrame:
    """(query, scope, n, tokens): each scope of a query gets an equal budget; ends before the entry that would overflow it."""
    scopes = rows.groupBy("query").agg(F.count_distinct("scope").alias("scopes"))
    order = Window.partitionBy("query", "scope").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("own", F.greatest(F.lit(1), token_estimate(entry))).withColumn("upto", F.sum("own").over(order)).join(scopes, "query")
    budget = F.greatest(F.lit(1), F.floor(F.lit(most_tokens) / F.col("scopes")))
    # A later entry that fits again doesn't count: sums only grow.
    return run.where(F.col("upto") <= budget).groupBy("query", "scope").agg(F.count("*").alias("n"), F.sum("own").alias("tokens"))


def merge_adjacent(rows: DataFrame, most: int = 3000) -> DataFrame:
    """(query, pos, n, content): neighbours of one source, section and kind joined by a blank line while under most characters.

    rows: (query, pos, source, section, kind, content); nulls count as empty, rows
    of equal pos come by content. Runs of like neighbours are found by windows; what
    joins within a run depends on what has joined before, so a run is folded.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "section", "kind", "content")]
    ready = rows.select("query", F.col("pos").cast("long").alias("pos"), *filled)
    order = Window.partitionBy("query").orderBy("pos", "content", "source", "section", "kind")
    key = F.struct("source", "section", "kind")
    runs = ready.withColumn("starts", F.coalesce((F.lag(key).over(order) != key).cast("int"), F.lit(1))).withColumn("run", F.sum("starts").over(order))
    lists = runs.groupBy("query", "run").agg(F.array_sort(F.collect_list(F.struct("pos", F.lit(1).alias("n"), "content"))).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["pos"].alias("pos"), (last["n"] + 1).alias("n"), F.concat(last["content"], F.lit("\n\n"), x["content"]).alias("content"))
        fits = F.length(last["content"]) + F.length(x["content"]) < most
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.array_append(acc, x))

    merged = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.slice("all", F.lit(1), F.lit(1)), step)
    return lists.select("query", F.explode(merged).alias("m")).select("query", "m.pos", "m.n", "m.content")


def select_context(rows: DataFrame, most: int = 16, per_source: int = 3, most_tokens: int = 9000) -> DataFrame:
    """(query, id, rank) chosen in order from (query, id, pos, source, content, low).

    Ids of any type; null content is empty, null low is useful. Passed over: useless rows, repeated ids, texts equal to one chosen or (over
    120 characters) within one, a source's fourth, and what the budget can't hold.
    """

    def fits(picked: Column, x: Column, _: Column) -> Column:
        again = F.exists(picked, lambda p: (p["id"] == x["id"]) | (p["norm"] == x["norm"]) | ((F.length(x["norm"]) > 120) & F.contains(p["norm"], x["norm"])))
        room = (folds.among(picked, lambda p: p["source"] == x["source"]) < per_source) & (folds.total(picked, "tokens") + x["tokens"] <= most_tokens)
        return ~again & room & (F.size(picked) < most)

    content = F.coalesce("content", F.lit(""))
    ready = rows.where(~F.coalesce("low", F.lit(False))).select("query", "id", "pos", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), normalized(content).alias("norm"), F.greatest(F.lit(1), token_estimate(content)).cast("long").alias("tokens"))
    return folds.chosen(ready, ("source", "norm", "tokens"), [fits])
