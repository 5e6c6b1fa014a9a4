"""Results as users see them: rows, previews, citations, related chunks, filters of what doesn't belong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.operators.vectors import ranked

#: Fields of a chunk and what stands where one is missing.
DEFAULTS = {"string": "", "int": 0, "long": 0, "double": 0.0, "boolean": False}


def with_defaults(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """rows with the columns of a schema {name: type}: missing columns and nulls get their type's default, arrays empty ones; extra columns go."""

    def one(name: str, kind: str) -> Column:
        empty = F.array().cast(kind) if kind.startswith("array") else F.lit(DEFAULTS.get(kind)).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), empty) if name in rows.columns else empty).alias(name)

    return rows.select(*[one(k, v) for k, v in schema.items()])


def rounded(score: Column) -> Column:
    """A score to four places, halves to even; null: 0."""
    return F.bround(F.coalesce(score, F.lit(0.0)), 4)


def preview(content: Column, most: int = 400) -> Column:
    """The text as one line; a longer one is cut at the last space within most characters and gets dots."""
    line = F.trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"\s+", " "))
    head = F.left(line, F.lit(most))
    whole = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.when(whole != "", whole).otherwise(head), F.lit("...")))


def excerpt(content: Column, most: int = 300) -> Column:
    """The first most characters; null: empty."""
    return F.left(F.coalesce(content, F.lit("")), F.lit(most))


def result_rows(hits: DataFrame, fields: Sequence[str], expanded: bool = False) -> DataFrame:
    """(query, index, fields..., score, excerpt, is_expanded) of hits (query, pos, score, content, fields...), index from 1."""
    out = ranked(hits.withColumnRenamed("score", "raw"), ["query"], [F.col("pos")])
    return out.select("query", F.col("rank").alias("index"), *fields, rounded(F.col("raw")).alias("score"), excerpt(F.col("content")).alias("excerpt"), F.lit(expanded).alias("is_expanded"))


def citations(hits: DataFrame) -> DataFrame:
    """(query, toc_paths, sources): sorted distinct titles and sources of (query, toc_path, source) rows; empty ones are left out."""
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return hits.groupBy("query").agg(some("toc_path").alias("toc_paths"), some("source").alias("sources"))


def related(asked: DataFrame, rows: DataFrame, siblings: int | None = None, children: bool = True) -> DataFrame:
    """(id, relation, nth, other): parent, siblings and children of asked ids, over rows (id, parent_id, place).

    Siblings share a parent and come in order of place, the first siblings of them;
    children come in order of place. Ids that no row has: nothing. Every relative
    is a row, so a family's size decides how many there are.
    """
    me = asked.select("id").distinct().join(rows, "id").select("id", "parent_id")
    there = rows.select(F.col("id").alias("other"), F.col("parent_id").alias("of"), "place")
    parent = me.join(there.select("other"), me.parent_id == F.col("other")).select("id", F.lit("parent").alias("relation"), F.lit(1).alias("nth"), "other")
    near = me.where("parent_id is not null").join(there, me.parent_id == there.of).where("other <> id")
    near = ranked(near, ["id"], [F.col("place"), F.col("other")], siblings).select("id", F.lit("sibling").alias("relation"), F.col("rank").alias("nth"), "other")
    out = parent.unionByName(near)
    if children:
        own = me.join(there, me.id == there.of)
        out = out.unionByName(ranked(own, ["id"], [F.col("place"), F.col("other")]).select("id", F.lit("child").alias("relation"), F.col("rank").alias("nth"), "other"))
    return out


# --- enrichment and slicing


def enrich(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, id, score, added, pos): hits and, after them, parents of edge chunks and document chunks of sources that have none.

    hits: (query, id, pos, score); chunks: (id, source, kind, parent_id). Edge chunks
    are neither documents nor sections. Parents come in order of the hits; then, by
    source, the first document chunk of each source of edge chunks that no document
    or section hit has, scored 0.5. Every id once; parents that don't exist: none.
    """
    rows = hits.join(chunks, "id")
    edge = ~F.coalesce(F.col("kind").isin("document", "section"), F.lit(False))
    known = chunks.select("id")
    up = rows.where(edge & F.col("parent_id").isNotNull()).groupBy("query", F.col("parent_id").alias("id")).agg(F.min("pos").alias("at")).join(known, "id", "left_semi")
    need = rows.where(edge & (F.coalesce(F.col("source").cast("string"), F.lit("")) != "")).select("query", "source").distinct()
    have = rows.where(~edge & (F.coalesce(F.col("source").cast("string"), F.lit("")) != "")).select("query", "source").distinct()
    first = chunks.where("kind = 'document'").groupBy("source").agg(F.min("id").alias("id"))
    docs = need.join(have, ["query", "source"], "left_anti").join(first, "source")
    met = hits.select("query", "id", F.col("score").cast("double").alias("score"), F.lit(0).alias("added"), F.col("pos").cast("long").alias("at"), F.lit("").alias("tie"))
    met = met.unionByName(up.select("query", "id", F.lit(0.0).alias("score"), F.lit(1).alias("added"), F.col("at").cast("long").alias("at"), F.lit("").alias("tie")))
    met = met.unionByName(docs.select("query", "id", F.lit(0.5).alias("score"), F.lit(2).alias("added"), F.lit(0).cast("long").alias("at"), F.col("source").cast("string").alias("tie")))
    once = met.groupBy("query", "id").agg(F.min(F.struct("added", "at", "tie", "score")).alias("m"))
    return ranked(once, ["query"], [F.col("m.added"), F.col("m.at"), F.col("m.tie"), F.col("id")]).select("query", "id", F.col("m.score").alias("score"), F.col("m.added").alias("added"), F.col("rank").alias("pos"))


def search_enriched(hits: DataFrame, chunks: DataFrame, top_k: int = 10, budget: int = 3) -> DataFrame:
    """(query, id, score, rank): the first top_k hits and up to budget of what enriches the first 2 top_k.

    hits: (query, id, pos, score), three times top_k of them, boosted already.
    """
    primary = hits.where(F.col("pos") <= top_k)
    more = enrich(hits.where(F.col("pos") <= 2 * top_k), chunks).join(primary.select("query", "id"), ["query", "id"], "left_anti")
    more = ranked(more, ["query"], [F.col("pos")], budget).select("query", "id", "score", (F.col("rank") + top_k).alias("at"))
    both = primary.select("query", "id", F.col("score").cast("double").alias("score"), F.col("pos").cast("int").alias("at")).unionByName(more)
    return ranked(both, ["query"], [F.col("at")]).select("query", "id", "score", "rank")


def result_limit(broad: Column, top_k: int, budget: int = 3, broad_least: int = 16) -> Column:
    """How many results a query may have after enrichment."""
    return F.when(broad, F.greatest(F.lit(top_k + budget), F.lit(broad_least))).otherwise(F.lit(top_k + budget))


def with_fallback(dense: DataFrame, sparse: DataFrame, fallback: DataFrame) -> DataFrame:
    """(query, id, rank) of the second list for fusion: sparse hits; a query without any takes fallback's. dense: what queries there are."""
    without = dense.select("query").distinct().join(sparse.select("query").distinct(), "query", "left_anti")
    return sparse.select("query", "id", "rank").unionByName(fallback.join(without, "query", "left_semi").select("query", "id", "rank"))


def reranked_or_not(before: DataFrame, scored: DataFrame, failures: DataFrame) -> DataFrame:
    """(query, id, rank, fallback): reranked lists; a query whose reranking failed keeps its list from before.

    before: (query, id, rank); scored: (query, id, score); failures: (query, error).
    """
    bad = failures.select("query").distinct()
    good = ranked(scored.join(bad, "query", "left_anti"), ["query"], [F.col("score").desc(), F.col("id")]).select("query", "id", "rank", F.lit(False).alias("fallback"))
    return good.unionByName(before.join(bad, "query", "left_semi").select("query", "id", "rank", F.lit(True).alias("fallback")))


# --- what doesn't belong


def merged_filters(first: dict | None, wins: dict | None) -> dict:
    """Both filters; of a name in both, that of wins."""
    return {**(first or {}), **(wins or {})}


def named_for(source: Column, prefixes: Sequence[str], pattern: str) -> Column:
    """Whether a source lies under one of the folders, or its base name fits a pattern; null: no."""
    low = F.lower(F.coalesce(source, F.lit("")))
    under = low.rlike("^(" + "|".join(prefixes) + ")/") if prefixes else F.lit(False)
    return under | F.regexp_extract(low, r"([^/]*)$", 1).rlike(pattern)


def uncontaminated(rows: DataFrame, ecosystem: Column, rules: dict[str, Column]) -> DataFrame:
    """rows of which a query's ecosystem allows: rules give, by ecosystem, which rows are foreign to it. No ecosystem or rule: all."""
    foreign = F.coalesce(*[F.when(ecosystem == k, v) for k, v in rules.items()], F.lit(False))
    return rows.where(~foreign)


def in_scopes(results: DataFrame, scope: Column, wanted: Column) -> DataFrame:
    """(rows..., dropped): results whose scope is the wanted one or common to all (''), and how many of a query's were dropped."""
    fits = F.coalesce(scope, F.lit("")).isin("") | (scope == wanted)
    marked = results.withColumn("fits", F.coalesce(fits, F.lit(False)))
    return marked.withColumn("dropped", F.sum((~F.col("fits")).cast("long")).over(Window.partitionBy("query"))).where("fits").drop("fits")
