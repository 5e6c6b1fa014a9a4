"""The document link graph: edges, bounded neighbours, expansion and hub priorities.

Edges are (src, dst, pos), pos being the link's place in its source. Expansion
works for many queries at once, a query being a column of the frontier; every
step is a join and a window within the query, with bounded rows each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.sources.shared import stored


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, pos) of (source, targets array): links to sources that exist, not to oneself, each once at its first place."""
    raw = pages.select(F.col("source").alias("src"), F.posexplode("targets").alias("pos", "dst"))
    there = pages.select(F.col("source").alias("dst")).distinct()
    return raw.where("src <> dst").groupBy("src", "dst").agg(F.min("pos").alias("pos")).join(there, "dst", "left_semi").select("src", "dst", "pos")


def canonical_pages(pages: DataFrame, path: str = "html_path") -> DataFrame:
    """pages with canonical: the path without a trailing _N if a page of that path exists, else its own."""
    base = F.regexp_replace(path, r"(?i)^(.+)_(\d+)\.html?$", "$1.htm")
    there = pages.select(F.col(path).alias("base")).distinct().withColumn("found", F.lit(True))
    return pages.withColumn("base", base).join(there, "base", "left").withColumn("canonical", F.when(F.col("found"), F.col("base")).otherwise(F.col(path))).drop("base", "found")


def neighbors(edges: DataFrame, most: int = 5, reverse: bool = True) -> DataFrame:
    """(src, dst, nth): the first most distinct neighbours, forward links in order, then the sources that link here by id."""
    both = edges.select("src", "dst", F.lit(0).alias("way"), F.col("pos").cast("long").alias("place"))
    if reverse:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("way"), F.lit(0).cast("long").alias("place"))
        both = both.unionByName(back)
    once = both.where("src <> dst").groupBy("src", "dst").agg(F.min(F.struct("way", "place", "dst")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy("at"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).select("src", "dst", "nth")


def expand(seeds: DataFrame, near: DataFrame, hops: int = 2, budget: int = 20, with_seeds: bool = False) -> DataFrame:
    """(query, node, hop, nth): seeds (query, node, nth) as hop 0 and what they lead to, at most budget more (with_seeds: at most budget in all).

    Within a hop the frontier takes turns: all first neighbours, then all second
    ones. A node counts where it is met first. Each hop is written out (budget rows
    a query at most), so that the next one doesn't compute it again.
    """
    met = stored(seeds.select("query", "node", F.lit(0).alias("hop"), F.col("nth").cast("long").alias("nth")), "seeds")
    frontier = met
    for hop in range(1, hops + 1):
        offers = frontier.select("query", F.col("node").alias("src"), F.col("nth").alias("turn")).join(near, "src").groupBy("query", F.col("dst").alias("node")).agg(F.min(F.struct("nth", "turn")).alias("at"))
        fresh = offers.join(met.select("query", "node"), ["query", "node"], "left_anti")
        fresh = fresh.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("at")))
        used = (met if with_seeds else met.where("hop > 0")).groupBy("query").agg(F.count("*").alias("used"))
        frontier = stored(fresh.join(used, "query", "left").where(F.col("nth") + F.coalesce("used", F.lit(0)) <= budget).select("query", "node", F.lit(hop).alias("hop"), F.col("nth").cast("long").alias("nth")), "frontier")
        met = met.unionByName(frontier)
    return met


def hub_priority(hubs: DataFrame, forward: DataFrame) -> DataFrame:
    """(query, node, priority): hubs (query, node) 3, what they link to 2, what that links to 1; the largest counts.

    Only sources that are no hubs pass the 1 on.
    """
    h = hubs.select("query", "node").distinct().withColumn("priority", F.lit(3))
    step = lambda rows, p: rows.select("query", F.col("node").alias("src")).join(forward, "src").select("query", F.col("dst").alias("node"), F.lit(p).alias("priority"))
    children = step(h, 2).distinct().join(h.select("query", "node"), ["query", "node"], "left_anti")
    return h.unionByName(children).unionByName(step(children, 1)).groupBy("query", "node").agg(F.max("priority").alias("priority"))


#: Which kinds of chunk stand for a linked source first, for narrow and for broad questions, and their score.
NARROW_KINDS, BROAD_KINDS, LINKED_SCORE = ("document", "section"), ("section", "document"), 0.3


def neighbour_chunks(found: DataFrame, chunks: DataFrame, broad: bool = False, per_source: int = 3) -> DataFrame:
    """(query, id, source, score, nth): the first per_source chunks (id, source, kind) of each found source (query, node, hop, nth), by kind, then id.

    What stands for a source doesn't depend on the query and is found once.
    """
    kinds = BROAD_KINDS if broad else NARROW_KINDS
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(kinds)], F.lit(len(kinds)))
    own = chunks.select("id", "source", order.alias("way")).withColumn("own", F.row_number().over(Window.partitionBy("source").orderBy("way", "id"))).where(F.col("own") <= per_source)
    rows = found.select("query", F.col("node").alias("source"), "hop", "nth").join(own, "source")
    at = F.row_number().over(Window.partitionBy("query").orderBy("hop", "nth", "own"))
    return rows.select("query", "id", "source", F.lit(LINKED_SCORE).alias("score"), at.alias("nth"))


def expand_hits(hits: DataFrame, chunks: DataFrame, edges: DataFrame, broad: bool = False, budget: int = 20) -> DataFrame:
    """(query, id, score, linked, pos): hits (query, id, pos, score, source), then chunks of the sources that theirs link to, each id once.

    One hop for narrow questions, two for broad ones; hits without a source lead nowhere.
    """
    first = hits.where(F.coalesce(F.col("source").cast("string"), F.lit("")) != "").groupBy("query", F.col("source").alias("node")).agg(F.min("pos").alias("nth"))
    found = expand(first, neighbors(edges), 2 if broad else 1, budget).where("hop > 0")
    more = neighbour_chunks(found, chunks, broad).join(hits.select("query", "id"), ["query", "id"], "left_anti")
    both = hits.select("query", "id", F.col("score").cast("double").alias("score"), F.lit(False).alias("linked"), F.col("pos").cast("long").alias("at"))
    both = both.unionByName(more.select("query", "id", "score", F.lit(True).alias("linked"), F.col("nth").cast("long").alias("at")))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("linked", "at"))).drop("at")
