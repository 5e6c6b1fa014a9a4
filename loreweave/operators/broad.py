"""Contexts of broad questions: seed sources, what they link to, representatives of each, priorities, selection.

All steps take many queries at once and are joins and windows within a query; what
represents a source doesn't depend on the query and is found once per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import context, graph, ranking
from loreweave.operators.vectors import ranked
from loreweave.sources.shared import stored


def seed_sources(hits: DataFrame, most: int = 4) -> DataFrame:
    """(query, node, nth): the first most distinct sources of a query's useful hits (query, pos, source, low), of all if none is useful.

    Hits without a source are passed over; null low: useful.
    """
    low = F.coalesce("low", F.lit(False))
    some = hits.where(F.coalesce(F.col("source").cast("string"), F.lit("")) != "").withColumn("useful", F.max(~low).over(Window.partitionBy("query")))
    first = some.where(~F.col("useful") | ~low).groupBy("query", F.col("source").alias("node")).agg(F.min("pos").alias("pos"))
    return ranked(first, ["query"], [F.col("pos"), F.col("node")], most).select("query", "node", F.col("rank").alias("nth"))


def discover(seeds: DataFrame, near: DataFrame, hops: int = 2, most: int = 32) -> DataFrame:
    """(query, node, nth): seeds and what they lead to over hops, most in all, in the order in which they are met."""
    met = graph.expand(seeds, near, hops, most, with_seeds=True)
    return ranked(met.withColumnRenamed("nth", "at"), ["query"], [F.col("hop"), F.col("at")]).select("query", "node", F.col("rank").alias("nth"))


#: Fixed value: sections of a source that may stand for it.
SECTIONS = 2


def candidates(chunks: DataFrame, sections: int = SECTIONS) -> DataFrame:
    """(id) of chunks (id, source, kind) that representatives() may take: no other needs to be judged. Contents aren't read."""
    own = F.row_number().over(Window.partitionBy("source", "kind").orderBy("id"))
    rows = chunks.where(F.col("kind").isin("document", "section")).select("id", "source", "kind").withColumn("place", own)
    return rows.where(F.col("place") <= F.when(F.col("kind") == "document", 1).otherwise(3 * sections)).select("id")


def representatives(chunks: DataFrame, most_chars: int = 9000, sections: int = SECTIONS) -> DataFrame:
    """(source, id, score, nth) of chunks (id, source, kind, content, low, bonus): what stands for a source.

    Its document chunk (the first by id) if that is useful and short enough, scored
    0.45; else the best useful ones of its first sections, by bonus, scored 0.4.
    Null content and source count as empty.
    """
    own = Window.partitionBy("source", "kind").orderBy("id")
    rows = chunks.where(F.col("kind").isin("document", "section")).withColumn("place", F.row_number().over(own)).withColumn("size", F.coalesce(F.length("content"), F.lit(0)))
    docs = rows.where("kind = 'document' and place = 1").where((F.col("size") <= most_chars) & ~F.col("low"))
    docs = docs.select("source", "id", F.lit(0.45).alias("score"), F.lit(1).alias("nth"))
    useful = rows.where("kind = 'section'").where((F.col("place") <= 3 * sections) & ~F.col("low")).join(docs.select("source"), "source", "left_anti")
    best = ranked(useful, ["source"], [F.round("bonus", 9).desc(), F.col("id")], sections)
    return docs.unionByName(best.select("source", "id", F.lit(0.4).alias("score"), F.col("rank").alias("nth")))


def hubs(found: DataFrame, forward: DataFrame) -> DataFrame:
    """(query, node) of (query, source, title_phrases): sources that link on and whose representative's title holds a phrase of the query."""
    linking = forward.select(F.col("src").alias("source")).distinct()
    return found.where("title_phrases > 0").join(linking, "source", "left_semi").select("query", F.col("source").alias("node")).distinct()


def prioritised(queries: DataFrame, sources: DataFrame, chunks: DataFrame, forward: DataFrame) -> DataFrame:
    """(query, id, source, score, priority, pos): representatives of a query's sources, best first.

    queries: (query, query_text); sources: (query, node, nth); chunks: (id, source,
    kind, title, content, low, bonus); forward: (src, dst, nth). Order: hub
    priority, phrases and terms in title and body, bonus, order of discovery.
    """
    stands = representatives(chunks).withColumnRenamed("nth", "own").join(chunks.select("id", "title", "content", "bonus"), "id")
    found = sources.select("query", F.col("node").alias("source"), "nth").join(stands, "source").join(queries, "query")
    judged = stored(ranking.match_priority(found, F.col("query_text"), F.col("title"), F.col("content")).drop("content", "query_text"), "representatives")
    first = graph.hub_priority(hubs(judged, forward), forward).withColumnRenamed("node", "source")
    out = judged.join(first, ["query", "source"], "left").withColumn("priority", F.coalesce("priority", F.lit(0)))
    order = [F.col(c).desc() for c in ("priority", "title_phrases", "title_terms", "body_phrases", "body_terms")] + [F.round("bonus", 9).desc(), F.col("nth"), F.col("own")]
    return ranked(out, ["query"], order).select("query", "id", "source", "score", "priority", F.col("rank").alias("pos"))


def assemble(queries: DataFrame, hits: DataFrame, chunks: DataFrame, edges: DataFrame, most: int = 16, per_source: int = 3, most_tokens: int = 9000) -> DataFrame:
    """(query, id, rank): the context of broad questions, representatives first, then the hits themselves.

    hits: (query, pos, id); chunks: (id, source, kind, title, content, low, bonus);
    edges: (src, dst, pos) between sources. Of a query whose rows are all useless
    the hits stay as they are.
    """
    near, forward = (stored(graph.neighbors(edges, reverse=way), "links") for way in (True, False))
    listed = stored(hits.join(chunks.select("id", "source", "content", "low"), "id"), "listed")
    sources = stored(discover(seed_sources(listed), near), "sources")
    stands = stored(prioritised(queries, sources, chunks, forward), "stands")
    rows = stands.join(chunks.select("id", "content", "low"), "id").select("query", "id", "source", "content", "low", F.col("pos").cast("long").alias("pos"))
    rows = rows.unionByName(listed.select("query", "id", "source", "content", "low", (F.col("pos") + 1_000_000).cast("long").alias("pos")))
    chosen = stored(context.select_context(rows, most, per_source, most_tokens), "chosen")
    rest = hits.join(chosen.select("query").distinct(), "query", "left_anti").select("query", "id", F.col("pos").cast("int").alias("rank"))
    return chosen.unionByName(rest.withColumn("id", F.col("id").cast(chosen.schema["id"].dataType)))


#: What an answer has to hold, by the kind of question.
CONTRACTS = {
    "broad": ("overview", "parts", "relations", "sources"),
    "comparison": ("each scope apart", "differences", "sources by scope"),
    "direct": ("answer", "sources"),
    "clarification": ("question back",),
}


def answer_contract(mode: Column, broad: Column, topics: Column, correction: Column | None = None) -> Column:
    """A struct that says what an answer must hold: kind, parts, topics to cover, and a notice to repeat ('' for none)."""
    kind = F.when(broad & (mode == "direct"), "broad").otherwise(F.coalesce(mode, F.lit("direct")))
    parts = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in CONTRACTS.items()])
    return F.struct(kind.alias("kind"), parts.alias("parts"), F.array_distinct(F.coalesce(topics, F.array().cast("array<string>"))).alias("topics"), F.coalesce(F.lit("") if correction is None else correction, F.lit("")).alias("notice"))


def judged(chunks: DataFrame, kind: Column, titles: list[Column]) -> DataFrame:
    """chunks with low and bonus, by kind and titles."""
    return chunks.withColumns({"low": text.is_low_utility("content", kind, titles), "bonus": text.quality_bonus("content", kind, titles)})
