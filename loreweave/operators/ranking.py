"""Fusion, boosts and selection over ranked lists.

A list is a DataFrame with query, id, a place (rank or pos, from 1) and what the
operator needs besides; operators that look at the whole list of a query see k
candidates of it, a bounded number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import match_count, normalized, plain_words
from loreweave.operators import folds
from loreweave.operators.vectors import ranked


def bm25(candidates: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, id, score, rank) of (query, query_text, id, text, pos): Okapi scores with statistics of the query's candidates only.

    Scores are compared to six places. Words are what stands between white space. A word that most candidates hold
    has a negative idf; it counts a quarter of the mean idf instead. A word that
    the query repeats counts each time. Ties keep the order of pos. A null text or
    query has no words: score 0. No candidates: no rows.
    """
    size = F.size(plain_words("text"))
    per_query = Window.partitionBy("query")
    base = candidates.select("query", "id", "pos", size.alias("size")).withColumns({"n": F.count("*").over(per_query), "mean": F.avg("size").over(per_query)})
    words = candidates.select("query", "id", F.explode(plain_words("text")).alias("word")).groupBy("query", "id", "word").agg(F.count("*").alias("tf"))
    df = words.groupBy("query", "word").agg(F.count("*").alias("df")).join(base.select("query", "n").distinct(), "query")
    idf = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    idf = idf.withColumn("idf", F.when(F.col("idf") < 0, 0.25 * F.avg("idf").over(per_query)).otherwise(F.col("idf"))).select("query", "word", "idf")
    asked = candidates.select("query", "query_text").distinct().select("query", F.explode(plain_words("query_text")).alias("word")).groupBy("query", "word").agg(F.count("*").alias("times"))
    hits = words.join(asked, ["query", "word"]).join(idf, ["query", "word"]).join(base.select("query", "id", "size", "mean"), ["query", "id"])
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    scores = base.select("query", "id", "pos").join(hits.groupBy("query", "id").agg(F.sum(part).alias("score")), ["query", "id"], "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))
    return ranked(scores, ["query"], [F.col("score").desc(), F.col("pos")]).select("query", "id", "score", "rank")


def fuse(first: DataFrame, second: DataFrame, weights: tuple[float, float] = (0.7, 0.3), k: int = 60) -> DataFrame:
    """(query, id, score, rank): weighted reciprocal ranks of two lists (query, id, rank).

    Ties keep the first list's order, then the second's. An id that a list has
    twice counts where it comes first; an empty list leaves the other's order.
    """
    both = first.select("query", "id", F.col("rank").alias("one"), F.lit(None).cast("int").alias("two")).unionByName(second.select("query", "id", F.lit(None).cast("int").alias("one"), F.col("rank").alias("two")))
    met = both.groupBy("query", "id").agg(F.min("one").alias("one"), F.min("two").alias("two"))
    score = F.round(F.coalesce(weights[0] / (k + F.col("one")), F.lit(0.0)) + F.coalesce(weights[1] / (k + F.col("two")), F.lit(0.0)), 9)
    return ranked(met.withColumn("score", score), ["query"], [F.col("score").desc(), F.col("one").asc_nulls_last(), F.col("two").asc_nulls_last()]).select("query", "id", "score", "rank")


def boost_titles(rows: DataFrame, titles: Column, terms: Column, factor: float = 0.15) -> DataFrame:
    """rows of (query, pos, score, ...) with score * (1 + factor * matching terms) and the new rank; without terms the order stays."""
    matches = F.when(F.size(terms) > 0, match_count(titles, terms)).otherwise(0)
    out = rows.withColumn("matches", matches).withColumn("score", F.col("score") * (1 + factor * F.col("matches")))
    order = [F.when(F.size(terms) > 0, F.round("score", 6)).desc(), F.col("pos")]
    return ranked(out, ["query"], order)


def keep_title_matches(chosen: DataFrame, candidates: DataFrame, titles: Column, terms: Column, most: int = 3) -> DataFrame:
    """(query, id, rank): the best title matches among candidates, by (matches, score, -pos), before the chosen list (query, id, pos)."""
    matching = candidates.withColumn("matches", match_count(titles, terms)).where("matches > 0")
    first = ranked(matching, ["query"], [F.col("matches").desc(), F.round("score", 6).desc(), F.col("pos")], most).select("query", "id", F.lit(0).alias("part"), F.col("rank").alias("place"))
    both = first.unionByName(chosen.select("query", "id", F.lit(1).alias("part"), F.col("pos").alias("place")))
    once = both.groupBy("query", "id").agg(F.min(F.struct("part", "place")).alias("at"))
    return ranked(once, ["query"], [F.col("at")]).select("query", "id", "rank")


#: Which kinds of chunk a reranker should see first.
KIND_ORDER = {"section": 0, "subsection": 1, "paragraph": 2, "table": 2, "code_block": 2, "list": 2, "document": 3, "image": 4}


def shape_rerank_input(rows: DataFrame, seeds: int = 0, most: int = 32, per_source: int = 2, keep_titles: int = 3) -> DataFrame:
    """rows of (query, id, pos, source, kind, title_match) that a reranker gets, with rank: at most most, per_source of a source.

    In order of (seed, kind, title match, pos): up to keep_titles title matches,
    then one of each source not there yet, then the rest. Rows without a source
    are each their own. Of equal ids the first counts.
    """
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KIND_ORDER.items() for x in pair]), F.col("kind")), F.lit(4))
    seed = F.when(F.min("pos").over(Window.partitionBy("query", "id")) <= seeds, 0).otherwise(1)
    key = F.struct(seed.alias("seed"), kind.alias("kind"), (~F.col("title_match")).cast("int").alias("title"), F.col("pos"))
    rows = rows.withColumn("key", key)
    rows = ranked(rows, ["query", "id"], [F.col("key")], 1).drop("rank")
    rows = rows.withColumn("own", F.when(F.coalesce("source", F.lit("")) != "", F.col("source")).otherwise(F.concat(F.lit("\x00"), F.col("id").cast("string"))))
    nth = F.row_number().over(Window.partitionBy("query", "own", "title_match").orderBy("key"))
    # Title matches beyond what one source may bring don't take one of the places kept for them.
    able = rows.withColumn("able", F.col("title_match") & (nth <= per_source))
    place = F.sum(F.col("able").cast("int")).over(Window.partitionBy("query").orderBy("key"))
    able = able.withColumn("early", F.col("able") & (place <= keep_titles))
    source = Window.partitionBy("query", "own")
    able = able.withColumn("in_source", F.row_number().over(source.orderBy(F.col("early").desc(), "key"))).where(F.col("in_source") <= per_source)
    met = F.max(F.col("early").cast("int")).over(source)
    phase = F.when(F.col("early"), 0).when((met == 0) & (F.col("in_source") == 1), 1).otherwise(2)
    return ranked(able.withColumn("phase", phase), ["query"], [F.col("phase"), F.col("key")], most).drop("key", "own", "able", "early", "in_source", "phase")


def rerank_text(content: Column, toc_path: Column, doc_title: Column, section: Column, most: int = 2400) -> Column:
    """Header of titles, a line's end and as much of the content as fits."""
    some = lambda x: F.when(x != "", x)
    header = F.concat_ws(" | ", some(F.array_join(toc_path, " > ")), some(doc_title), F.when((section != "") & (section != doc_title), section))
    lead = F.when(header != "", F.concat(header, F.lit("\n"))).otherwise("")
    return F.left(F.concat(lead, content), F.lit(most))


def lexical_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: share of the query's distinct words that the text holds."""
    asked = F.array_distinct(plain_words(query))
    return F.round(F.size(F.array_intersect(asked, plain_words(text))) / F.greatest(F.size(asked), F.lit(1)), 6)


def diverse(rows: DataFrame, most: int = 14, most_sources: int = 8, least_sources: int = 3, per_source: int = 3) -> DataFrame:
    """(query, id, rank) chosen from (query, id, pos, source, topic, low): first sources, then topics, then by place.

    Greedy over a query's candidate pool (40 rows or so), so a query is one group.
    Useless rows (low; null: useful) take part only if a query has no others. Null
    source and topic count as empty; ids of any type; no rows: none.
    """

    def fits(wanted) -> folds.Rule:
        def rule(picked: Column, x: Column, _: Column) -> Column:
            own = folds.among(picked, lambda p: p["source"] == x["source"])
            sources = F.size(F.array_distinct(F.transform(picked, lambda p: p["source"])))
            able = ~F.exists(picked, lambda p: p["id"] == x["id"]) & (own < per_source) & ((own > 0) | (sources < most_sources)) & (F.size(picked) < most)
            return able & wanted(picked, x, own, sources)

        return rule

    rules = (
        fits(lambda picked, x, own, sources: (sources < least_sources) & (own == 0)),
        fits(lambda picked, x, own, sources: ~F.exists(picked, lambda p: (p["source"] == x["source"]) & (p["topic"] == x["topic"]))),
        fits(lambda picked, x, own, sources: F.lit(True)),
    )
    useful = lambda all_: F.when(F.exists(all_, lambda x: ~x["low"]), F.filter(all_, lambda x: ~x["low"])).otherwise(all_)
    ready = rows.select("query", "id", "pos", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.lower(F.coalesce("topic", F.lit(""))).alias("topic"), F.coalesce("low", F.lit(False)).alias("low"))
    return folds.chosen(ready, ("source", "topic", "low"), rules, useful)


def confidence(rows: DataFrame) -> DataFrame:
    """(query, confidence) of (query, score, rank): high, medium or low by the first and third score."""
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("score")))
    s = rows.groupBy("query").agg(at(1).alias("one"), at(3).alias("three"), F.count("*").alias("n"))
    level = F.when((F.col("one") > 0.8) & (F.col("n") >= 3) & (F.col("one") - F.col("three") > 0.2), "high").when(F.col("one") > 0.5, "medium").otherwise("low")
    return s.select("query", level.alias("confidence"))


def with_scores(rows: DataFrame, scores: DataFrame, missing: float = -1000.0) -> DataFrame:
    """rows of (query, id, ...) with a provider's score (query, id, score); rows that it left out come last."""
    return rows.join(scores, ["query", "id"], "left").withColumn("score", F.coalesce("score", F.lit(missing)))


def match_priority(rows: DataFrame, query_text: Column, titles: Column, body: Column) -> DataFrame:
    """rows with title_phrases, title_terms, body_phrases and body_terms: how much of the query a text holds.

    Terms are runs of three or more of a-z, 0-9 and underscore; phrases are pairs
    of neighbouring terms. Of the body the first 5000 characters count.
    """
    terms = F.filter(F.regexp_extract_all(F.lower(query_text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda x: F.length(x) >= 3)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_terms") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("_terms", i - 1), F.get("_terms", i)))
    phrases = F.when(F.size("_terms") > 1, pairs).otherwise(F.array().cast("array<string>"))
    held = lambda text, what: F.size(F.filter(what, lambda x: F.contains(text, x)))
    ready = rows.withColumn("_terms", terms).withColumn("_phrases", phrases).withColumns({"_title": normalized(titles), "_body": normalized(F.left(body, F.lit(5000)))})
    counts = {f"{where}_{what}": held(F.col(f"_{where}"), F.col(f"_{what}")) for where in ("title", "body") for what in ("phrases", "terms")}
    return ready.withColumns(counts).drop("_terms", "_phrases", "_title", "_body")


def dedup_variants(rows: DataFrame, per_source: int = 3) -> DataFrame:
    """(query, id, rank) of (query, id, pos, source, canonical, hash): one source of each canonical and of each hash, in order.

    A source that isn't its canonical goes if that is among the query's sources. A
    source turned away by its hash doesn't claim its canonical, so the rows of a
    query (a bounded list) are gone through in order. Nulls count as empty; an empty
    hash is like no other.
    """

    def fits(picked: Column, x: Column, all_: Column) -> Column:
        variant = (x["canonical"] != x["source"]) & F.exists(all_, lambda p: p["source"] == x["canonical"])
        other = F.exists(picked, lambda p: (p["id"] == x["id"]) | ((p["source"] != x["source"]) & ((p["canonical"] == x["canonical"]) | ((x["hash"] != "") & (p["hash"] == x["hash"])))))
        return ~variant & ~other & (folds.among(picked, lambda p: p["source"] == x["source"]) < per_source)

    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "canonical", "hash")]
    return folds.chosen(rows.select("query", "id", "pos", *filled), ("source", "canonical", "hash"), [fits])
