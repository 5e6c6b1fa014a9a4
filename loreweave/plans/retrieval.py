"""Retrieval as a composition: every query of a table goes through the same plan at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import broad as broad_context
from loreweave.operators import context, graph, ranking, results, routing, store, vectors
from loreweave.sources.shared import stored


@dataclass
class Corpus:
    """What searches over a corpus share: term counts (a row for each text, or for each term of it) and the vocabulary, computed once and kept as tables."""

    counts: DataFrame
    vocab: DataFrame

    @classmethod
    def of(cls, docs: DataFrame) -> Corpus:
        """Of documents (id, text)."""
        counts = stored(vectors.counted_rows(docs, "id", "text"), "term-counts")
        return cls(counts, stored(vectors.vocabulary(counts, docs.count()), "vocabulary"))


def title_words(query_text: Column) -> Column:
    """Distinct words of over three characters of a text's first line."""
    return F.array_distinct(F.filter(F.split(F.lower(text.title(query_text)), " "), lambda x: F.length(x) > 3))


def searched(queries: DataFrame, docs: DataFrame, corpus: Corpus, embeddings: DataFrame | None = None, most: int = 20) -> DataFrame:
    """(query, id, score, rank): sparse hits of queries (id, text) among docs (id, text); with embeddings fused with dense ones.

    A query of which no term is known, but which has dense neighbours, takes these
    in order of their words (BM25 over them) for its sparse list.
    """
    sparse = vectors.sparse_search(queries.select("id", "text"), corpus.counts, corpus.vocab, most, docs.select("id"))
    if embeddings is None:
        return stored(sparse, "hits")
    sparse = stored(sparse, "sparse-hits")
    vecs = embeddings.join(queries.select("id"), "id", "left_semi")
    dense = stored(vectors.dense_top_k(vecs, embeddings.join(docs.select("id"), "id", "left_semi"), most), "dense-hits")
    bare = dense.join(sparse.select("query").distinct(), "query", "left_anti").select("query", "id", F.col("rank").alias("pos"))
    asked = queries.select(F.col("id").alias("query"), F.col("text").alias("query_text"))
    worded = ranking.bm25(stored(bare.join(docs.select("id", "text"), "id").join(asked, "query"), "fallback-texts"))
    return stored(ranking.fuse(dense, results.with_fallback(dense, sparse, worded)), "hits")


def reranked(judged: DataFrame, most: int, failed: DataFrame | None = None) -> DataFrame:
    """judged rows (query, id, pos, score, low, ...) with rank: useful ones first, by score, most of a query; a query that failed keeps its order."""
    out = vectors.ranked(judged, ["query"], [F.coalesce("low", F.lit(False)).cast("int"), F.col("score").desc(), F.col("id")], most)
    if failed is None:
        return out
    bad = failed.select("query").distinct()
    return out.join(bad, "query", "left_anti").unionByName(vectors.ranked(judged.join(bad, "query", "left_semi"), ["query"], [F.col("pos"), F.col("id")], most))


def retrieve(
    queries: DataFrame, docs: DataFrame, embeddings: DataFrame | None = None, broad: bool = False, top_k: int = 5, most_tokens: int = 4000,
    glossary: DataFrame | None = None, edges: DataFrame | None = None, corpus: Corpus | None = None, failed: DataFrame | None = None,
) -> DataFrame:
    """(query, id, rank, score, tokens) of queries (id, text and, if known, title_terms) over docs (id, text, source and, if known, kind, parent, place, parent_id).

    Sparse search of the queries, with a glossary (entry, terms, expansions) of what
    it adds to them; fused with dense search where embeddings (id, embedding, of
    docs and queries) are given; title boost; with parent_id parents of small chunks
    and documents of their sources; with edges (src, dst, pos between sources) chunks
    of linked sources; shaping for the reranker; rerank (queries in failed keep the
    order they had); for broad queries useless chunks last, then source and topic
    coverage; title matches kept; with parents parents and siblings; for broad
    queries with edges the assembled context; token budget. A query without any
    known term or vector has no rows. corpus: shared by several calls, of all docs
    or more.
    """
    rows_of = docs if "kind" in docs.columns else docs.withColumn("kind", F.lit("section"))
    if glossary is not None:
        told = stored(routing.expand_queries(queries.select(F.col("id").alias("query"), "text"), glossary), "expanded-queries")
        queries = queries.drop("text").join(told.select(F.col("query").alias("id"), F.col("expanded").alias("text")), "id")
    given = F.col("title_terms") if "title_terms" in queries.columns else title_words(F.col("text"))
    asked = queries.select(F.col("id").alias("query"), F.col("text").alias("query_text"), given.alias("_wanted"))
    hits = searched(queries, docs, corpus or Corpus.of(docs), embeddings)
    terms, columns = F.col("_wanted"), ("query", "id", "pos", "score", "text", "source", "kind", "query_text", "_wanted")
    whole = rows_of.select("id", "text", "source", "kind")
    full = lambda rows: rows.join(whole, "id").join(asked, "query").select(*columns)
    rows = full(hits.withColumnRenamed("rank", "pos").select("query", "id", "pos", "score"))
    boosted = ranking.boost_titles(rows, text.title("text"), terms).drop("pos", "matches").withColumnRenamed("rank", "pos").select(*columns)
    if "parent_id" in docs.columns:
        first = stored(boosted.select("query", "id", "pos", "score"), "boosted-hits")
        enriched = results.search_enriched(first, rows_of.select("id", "source", "kind", "parent_id"), 2 * top_k).withColumnRenamed("rank", "pos")
        boosted = full(stored(enriched.select("query", "id", "pos", "score"), "enriched-hits"))  # few rows, so that texts stay where they are
    if edges is not None:
        reached = graph.expand_hits(stored(boosted.drop("_wanted"), "boosted-hits"), whole, edges, broad)
        boosted = full(stored(reached.select("query", "id", "pos", "score"), "reached-hits"))
    boosted = stored(boosted, "candidates")
    ready = boosted.withColumn("title_match", text.match_count(text.title("text"), terms) > 0)
    shaped = ranking.shape_rerank_input(ready, seeds=20).drop("pos").withColumnRenamed("rank", "pos")
    judged = shaped.withColumn("score", ranking.lexical_score(F.col("query_text"), ranking.rerank_text(F.col("text"), F.array("source"), text.title("text"), F.lit(""))))
    titles = [text.title("text")]
    judged = judged.withColumn("low", text.is_low_utility("text", F.col("kind"), titles) if broad else F.lit(False))
    if broad:
        judged = judged.withColumn("score", F.col("score") + text.quality_bonus("text", F.col("kind"), titles))
    best = reranked(judged, 40 if broad else top_k, failed).drop("pos").withColumnRenamed("rank", "pos")
    if broad:
        chosen = ranking.diverse(best.withColumn("topic", text.title("text"))).withColumnRenamed("rank", "pos")
    else:
        chosen = best.select("query", "id", "pos")
    kept = ranking.keep_title_matches(chosen, boosted, text.title("text"), terms).withColumnRenamed("rank", "pos")
    if {"parent", "place"} <= set(docs.columns):
        kept = store.expand_family(kept, docs.select("id", "parent", "place")).drop("relation").withColumnRenamed("rank", "pos")
    if broad and edges is not None:
        kept = stored(kept.select("query", "pos", "id"), "kept")
        able = stored(broad_context.candidates(rows_of).unionByName(kept.select("id")).distinct(), "context-ids")
        chunks = rows_of.join(able, "id", "left_semi").select("id", "source", "kind", text.title("text").alias("title"), F.col("text").alias("content"))
        chunks = stored(broad_context.judged(chunks, F.col("kind"), [F.col("title")]), "judged-chunks")
        kept = broad_context.assemble(asked.drop("_wanted"), kept, chunks, edges).withColumnRenamed("rank", "pos")
    scores = boosted.groupBy("query", "id").agg(F.max("score").alias("score"))
    kept = stored(kept.select("query", "id", "pos"), "kept-rows")
    out = kept.join(docs.select("id", F.col("text").alias("content")), "id").join(scores, ["query", "id"], "left")
    return context.compress(out, most_tokens).select("query", "id", F.col("pos").alias("rank"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), "tokens")


def retrieve_planned(
    queries: DataFrame, docs: DataFrame, rules: routing.PlanRules, glossary: DataFrame | None = None, embeddings: DataFrame | None = None, edges: DataFrame | None = None,
    top_k: int = 5, most_tokens: int = 4000, failed: DataFrame | None = None,
) -> DataFrame:
    """(query, broad, id, rank, score, tokens, dropped): retrieve() as each query's plan says, all in one call.

    queries: (query, text and, if known, scope_software); docs: as retrieve()'s, with
    scope ('' for what is common to all). The plan expands the query, gives its title
    terms, says whether it is broad and which scope it is filtered to; blocked and
    ambiguous queries have no rows. Search, links and families stay in the filter's
    documents; what is of another scope all the same goes, and dropped says how many
    rows of the query that were.
    """
    plans = stored(routing.plan(queries, rules, glossary), "plans").where(~F.col("blocked") & ~F.col("ambiguous"))
    corpus = Corpus.of(docs)
    key = F.array_join(F.coalesce("filter_software", F.array()), "\n")
    parts = []
    # A way through the plan for each filter that occurs, of which the rules have a few; all over one corpus.
    for way in plans.select("broad", key.alias("key"), "filter_software").distinct().collect():
        some = plans.where((F.col("broad") == way.broad) & (key == way.key) & F.col("filter_software").isNull().eqNullSafe(F.lit(way.filter_software is None)))
        own = docs if way.filter_software is None else docs.where(F.coalesce("scope", F.lit("")).isin(list(way.filter_software)))
        some = some.select(F.col("query").alias("id"), F.col("expanded").alias("text"), "title_terms")
        parts.append(retrieve(some, own.drop("scope"), embeddings, way.broad, top_k, most_tokens, edges=edges, corpus=corpus, failed=failed).withColumn("broad", F.lit(way.broad)))
    if not parts:
        parts = [retrieve(plans.select(F.col("query").alias("id"), F.col("expanded").alias("text"), "title_terms"), docs.drop("scope"), corpus=corpus).withColumn("broad", F.lit(False))]
    found = reduce(DataFrame.unionByName, parts).join(docs.select("id", "scope"), "id").join(plans.select("query", "filter_software"), "query")
    wanted = F.when(F.coalesce(F.array_contains("filter_software", F.col("scope")), F.lit(True)), F.col("scope"))
    kept = results.in_scopes(found, F.col("scope"), wanted)
    return vectors.ranked(kept.withColumnRenamed("rank", "at"), ["query"], [F.col("at"), F.col("id")]).select("query", "broad", "id", "rank", "score", "tokens", "dropped")


def retrieve_scopes(routes: DataFrame, queries: DataFrame, docs: DataFrame, scopes: Sequence[routing.Scope], top_k: int = 5) -> DataFrame:
    """(query, scope, rank, id, score): each route's scopes answer by themselves, from their documents (id, text, source, scope) only.

    One plan a scope, of which configuration has a few, over one corpus: terms are
    counted and the vocabulary fitted once. Lists of a query follow one another in
    the order of its route. Queries that are asked back have none.
    """
    by = stored(routing.branches(routes), "branches")
    corpus = Corpus.of(docs)
    parts = []
    for s in scopes:
        asked = queries.join(by.where(F.col("scope") == s.key).select(F.col("query").alias("id")), "id", "left_semi")
        own = docs.where((F.col("scope") == s.key) | (F.col("scope") == "")).drop("scope")
        parts.append(retrieve(asked, own, top_k=top_k, corpus=corpus).select("query", F.lit(s.key).alias("scope"), F.col("rank").alias("pos"), "id", "score"))
    out = reduce(DataFrame.unionByName, parts)
    return routing.grouped(out, by).select("query", "scope", "rank", "id", "score")
