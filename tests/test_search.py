"""Searches that skip, against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreweave.operators import chunking, mentions, quantiser, routing, sparse_index, vectors

SPARSE = "id long, index int, weight double"


def sparse_rows(rng, n, terms):
    """Documents of terms with Zipf's frequencies; repeated ones, and long ones."""
    out = []
    for i in range(n):
        for t in {min(terms - 1, int(rng.paretovariate(0.7)) - 1) for _ in range(rng.choice([3, 10, 60]))}:
            out.append((i, t, rng.randrange(1, 5) * (1 + t / 50)))
        if i % 7 == 0 and i:
            out += [(i, t, w) for j, t, w in out if j == i - 1 and (i, t) not in {(a, b) for a, b, _ in out[-80:]}]
    return out


def plain(queries, docs, k):
    by_doc, by_query = {}, {}
    for rows, held in ((docs, by_doc), (queries, by_query)):
        for i, t, w in rows:
            held.setdefault(i, {})[t] = w
    out = {}
    for q, v in by_query.items():
        found = [(-round(sum(w * d[t] for t, w in v.items() if t in d), 6), i) for i, d in by_doc.items() if v.keys() & d.keys()]
        out[q] = [(i, -s) for s, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


@pytest.mark.parametrize("segment, held", [(1 << 21, 4096), (700, 5)])
def test_sparse_top_k_against_plain_sums(spark, segment, held):
    rng = random.Random(3)
    docs, queries = sparse_rows(rng, 400, 200), sparse_rows(rng, 25, 220)
    found = sparse_index.top_rows(spark.createDataFrame(queries, SPARSE), spark.createDataFrame(docs, SPARSE).repartition(3), 7, segment, held)
    got = {}
    for r in vectors.ranked(found, ["query"], [F.col("score").desc(), F.col("id")], 7).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.id, r.score))
    want = plain(queries, docs, 7)
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in rows], abs=2e-6)
        assert [i for i, _ in got[q]] == [i for i, _ in rows]


def test_few_postings_are_scored():
    """Of the postings of the queries' terms under a third are looked at."""
    rng = np.random.default_rng(5)
    n, terms = 20_000, 3000
    size = rng.integers(5, 60, n)
    term = np.minimum(terms - 1, rng.zipf(1.3, size.sum()) - 1)
    doc = np.repeat(np.arange(n), size)
    pair = np.unique(doc * terms + term)
    doc, term = pair // terms, pair % terms
    weight = rng.pareto(2.0, len(term)) + 1 + np.log(terms / (1 + term))
    starts = np.searchsorted(doc, np.arange(n + 1))
    index = sparse_index.Segment(pa.array(np.arange(n)), starts, term, weight)
    whole = 0
    for _ in range(50):
        q = np.unique(np.minimum(terms - 1, rng.zipf(1.3, 8) - 1))
        w = 1.0 + rng.random(len(q))
        docs, scores = index.search(q, w, 10)
        dense = np.zeros(terms)
        dense[q] = w
        want = np.round(np.bincount(doc, weights=dense[term] * weight, minlength=n), 6)
        order = np.lexsort((np.arange(n), -want))[:10]
        assert np.allclose(scores, want[order], atol=2e-6) and set(docs) >= {i for i in order if want[i] > want[order[-1]] + 1e-5}
        whole += int(np.isin(term, q).sum())
    assert index.scored < whole / 3


def test_no_key_has_all_documents(spark):
    docs = spark.createDataFrame([(i, t, 1.0) for i in range(2000) for t in (0, i % 50 + 1)], SPARSE)
    asked = spark.createDataFrame([(1, 0, 1.0), (1, 3, 2.0)], SPARSE)
    out = sparse_index.top_rows(asked, docs, 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "index" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x).replace("cell", "")
    assert out.count() <= 5 * 4


def test_sparse_search_takes_odd_rows(spark):
    docs = spark.createDataFrame([("a", 1, 2.0), (None, 1, 9.0), ("b", 1, 2.0)], "id string, index int, weight double")
    asked = spark.createDataFrame([(7, 1, 1.0), (8, 5, 1.0), (None, 1, 1.0)], SPARSE)
    assert [tuple(r) for r in vectors.sparse_top_k(asked, docs).orderBy("rank").collect()] == [(7, "a", 2.0, 1), (7, "b", 2.0, 2)]
    assert vectors.sparse_top_k(asked, docs.limit(0)).count() == 0
    assert vectors.sparse_top_k(asked.limit(0), docs).count() == 0


def test_items_of_a_long_document_are_swept(spark):
    """20,000 items in one document of 200,000 lines, sections across stretches."""
    starts = sorted(random.Random(1).sample(range(10, 200_000), 300))
    bounds = [("long", s, s, e - 1) for s, e in zip(starts, [*starts[1:], 190_001], strict=True)] + [("b", 2, 2, 5)]
    items = [("long", i * 10) for i in range(20_000)] + [("b", 1), ("b", 2), ("b", 5), ("b", 5), ("b", 6), ("c", 1), ("b", None)]
    out = chunking.items_in_sections(spark.createDataFrame(items, "id string, item_line int"), spark.createDataFrame(bounds, "id string, pos int, start_line int, end_line int"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = sorted((d, p, i) for d, i in items if i is not None for b, p, s, e in (bounds if d == "b" else [max((b for b in bounds if b[0] == d and b[1] <= i), default=("x", 0, 1, 0))]) if b == d and s <= i <= e)
    assert sorted(map(tuple, out.collect())) == want


def test_mentions_against_plain_substrings(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcé", k=rng.randrange(1, 6))) for _ in range(300)]
    glossary = [(i, rng.sample(words, rng.randrange(0, 4)) + ([None, ""] if i % 9 == 0 else [])) for i in range(120)] + [(200, None), (None, ["a"])]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=6)).upper()) for i in range(60)] + [("none", None), ("empty", ""), ("q1", "aab")]
    df, g = spark.createDataFrame(asked, "query string, text string"), spark.createDataFrame(glossary, "entry long, terms array<string>")
    want = sorted({(q, e) for q, t in asked for e, terms in glossary if e is not None and any(x and x.lower() in (t or "").lower() for x in terms or [])})
    for most in (mentions.MOST_CHARS, 200):
        out = mentions.mentions(df, g, most)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect())) == want
    assert mentions.mentions(df, g.limit(0)).count() == mentions.mentions(df.limit(0), g).count() == 0


def test_no_term_of_a_glossary_goes_through_the_driver(spark, monkeypatch):
    g = spark.range(5000).select(F.col("id").alias("entry"), F.array(F.concat(F.lit("t"), "id"), F.lit("all")).alias("terms"), F.array(F.concat(F.lit("x"), F.col("id") % 2)).alias("expansions"))
    asked = spark.createDataFrame([(1, "of T77 and t4999"), (2, "ALL"), (3, "none")], "query long, text string")
    broadcast, to_arrow, collect = [], [], type(asked).collect
    rows = lambda df: sorted(map(tuple, collect(df)))
    few = lambda df: got if len(got := collect(df)) < 10 else pytest.fail("rows at the driver")
    with monkeypatch.context() as m:
        m.setattr(type(asked), "toArrow", lambda df: to_arrow.append(df))
        m.setattr(type(spark.sparkContext), "broadcast", lambda *x: broadcast.append(x))
        m.setattr(type(asked), "collect", few)
        for most in (mentions.MOST_CHARS, 4000):
            found = mentions.mentions(asked, g, most)
            assert rows(found.groupBy("query").count()) == [(1, 6), (2, 5000)]
        told = routing.expand_queries(asked, g).select("query", "matched", "expanded")
        assert rows(told) == [(1, 6, "of T77 and t4999 x0 x1"), (2, 5000, "ALL x0 x1"), (3, 0, "none")]
    assert not broadcast and not to_arrow


def test_glossary_entries_that_are_alike_count_once(spark):
    """Ten thousand entries of which five differ: a query meets five rows, and all of them count."""
    kinds = F.when(F.col("id") % 5 < 3, F.array(F.lit("hot"), F.concat(F.lit("k"), F.col("id") % 5))).otherwise(F.array(F.concat(F.lit("k"), F.col("id") % 5)))
    g = spark.range(10_000).select(F.col("id").alias("entry"), kinds.alias("terms"), F.array(F.concat(F.lit("x"), F.col("id") % 5)).alias("expansions"))
    few = routing.alike(g, ("expansions", "terms"))
    assert sorted(tuple(r)[:3] for r in few.collect()) == [(i, 9995 + i, 2000) for i in range(5)]
    told = routing.expand_queries(spark.createDataFrame([(1, "k4 is hot"), (2, "k3")], "query long, text string"), g)
    assert sorted((r["query"], r.matched, r.expanded) for r in told.collect()) == [(1, 8000, "k4 is hot x0 x1 x2 x4"), (2, 2000, "k3 x3")]


def test_plans_with_a_glossary_against_plain_loops(spark):
    rng = random.Random(5)
    words, some = [f"w{i}" for i in range(8)], lambda *x: rng.choice(x)
    glossary = [(rng.randrange(30), rng.sample(words, rng.randrange(1, 4)), rng.sample("pqrs", rng.randrange(0, 3)), some(None, "", "a", "b"), some(None, "", "a1", "b1"), some(None, "", "f", "g")) for _ in range(40)]
    glossary += [(100 + i, ["w0"], ["p"], some(None, "a", "b"), None, some("f", "g")) for i in range(20)]
    asked = [(i, " ".join(rng.sample(words, 2) + rng.sample(["alpha", "beta", "else"], 1))) for i in range(40)]
    rules = routing.PlanRules(ecosystems=(("a", ("alpha",)), ("b", ("beta",))), versions=(("a", (("a1", ("a1",)),)), ("b", (("b1", ("b1",)),))))
    schema = "entry long, terms array<string>, expansions array<string>, ecosystem string, software string, family string"
    got = routing.plan(spark.createDataFrame(asked, "query long, text string"), rules, spark.createDataFrame(glossary, schema)).collect()

    def planned(query, text):
        own = "a" if "alpha" in text else "b" if "beta" in text else None
        met = {g[0] for g in glossary if any(t in text for t in g[1])}
        rows = sorted((g for g in glossary if g[0] in met), key=lambda g: [(x is not None, x) for x in (*g[:4], g[5])])
        fits = [g for g in rows if not (own and g[3] and g[3] != own) and not (own and g[4] and g[4][0] != own)]
        last = lambda n: ([g[n] for g in fits if g[n]] or [None])[-1]
        eco = own or last(3)
        family = last(5) if eco is None or last(3) is None or eco == last(3) else None
        first = lambda x: list(dict.fromkeys(x))
        return query, eco, family, first(t for g in fits for t in [*g[2], *g[1]] if len(t) > 1), " ".join([text, *first(t for g in fits for t in g[2])])

    assert sorted((r["query"], r.ecosystem, r.family, r.title_terms, r.expanded) for r in got) == [planned(*a) for a in asked]


def test_one_pass_finds_overlapping_terms():
    found = mentions.automaton([("he", 0), ("she", 1), ("hers", 2), ("he", 3), ("", 4)])
    assert mentions.spotted(found, "ushers") == {0, 1, 2, 3} and mentions.spotted(found, "") == set() and mentions.spotted(None, "x") == set()


def clustered(rng, n, width=16, centres=12):
    c = rng.normal(size=(centres, width)) * 3
    return (c[rng.integers(0, centres, n)] + rng.normal(size=(n, width))).astype(float)


def test_cells_find_nine_in_ten_and_score_exactly(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 1500)
    x[700:1100] = x[5]  # one cell with a quarter of all rows
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>").repartition(4)
    odd = spark.createDataFrame([(None, x[0].tolist()), (9001, None), (9002, [1.0, None]), (9003, [1.0]), (9004, [])], "id long, embedding array<double>")
    model = quantiser.fit(v, k=10)
    exact = vectors.dense_top_k(v.where("id % 20 = 0"), v, 10)
    found = quantiser.search(v.where("id % 20 = 0").unionByName(odd), v.unionByName(odd), model, 10)
    scores = {(r.query, r.id): r.score for r in exact.collect()}
    rows = found.collect()
    assert quantiser.recall_of(found, exact).first().recall >= 0.9
    assert model.probes < model.cells / 2  # clusters take few probes
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(r.score - unit[r.query] @ unit[r.id]) < 1e-6 and r.query != r.id for r in rows)
    assert all(abs(scores[r.query, r.id] - r.score) < 1e-6 for r in rows if (r.query, r.id) in scores)


def test_cells_of_no_rows_and_of_parts(spark, monkeypatch):
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert quantiser.fit(empty) is None and quantiser.search(empty, empty, None).count() == 0
    x = clustered(np.random.default_rng(1), 300)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    model = quantiser.fit(v, k=5, recall=1.0, cells=4)
    want = sorted(map(tuple, quantiser.search(v.where("id < 20"), v, model, 5).collect()))
    monkeypatch.setattr(quantiser, "PART", 16)
    assert sorted(map(tuple, quantiser.search(v.where("id < 20"), v, model, 5).collect())) == want


def _shuffled(spark, run):
    """Rows that run's stages write for shuffles."""
    jvm, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def all_():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = all_()
    run()
    return sum(n for k, n in all_().items() if k not in before)


def test_a_search_shuffles_no_term_of_a_document(spark):
    from loreweave.plans import retrieval

    rng = random.Random(4)
    pool = [f"w{i}" for i in range(150)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(pool, 100))) for i in range(400)], "id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4 nothing")], "id long, text string")
    found = []
    n = _shuffled(spark, lambda: found.extend(retrieval.searched(asked, docs, retrieval.Corpus.of(docs)).collect()))
    assert len(found) == 40 and n < 400 * 100 / 4


def test_counts_of_repeated_null_and_empty_rows(spark):
    rows = [(1, "a b a"), (1, "c a"), (2, None), (3, ""), (None, "a"), (None, "b a"), (4, "b")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = [(None, "a", 2, 0), (None, "b", 1, 0), (1, "a", 3, 0), (1, "b", 1, 1), (1, "c", 1, 0), (4, "b", 1, 0)]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, vectors.term_counts(df, "id", "text").collect()), key=key) == want
    assert vectors.term_counts(df.limit(0), "id", "text").count() == 0
    texts = spark.createDataFrame([("x", "a"), ("y", "b b")], "id string, text string")
    assert sorted(map(tuple, vectors.term_counts(texts, "id", "text").collect())) == [("x", "a", 1, 0), ("y", "b", 2, 0)]


@pytest.mark.parametrize("most", [1, 400, 1 << 26])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_frequencies_of_counted_rows_are_those_of_all_terms(spark, most, kind):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(40)] + ["é", "中"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randrange(0, 30)))) for i in rng.sample(range(1000), 120)] + [(None, "w1 w2"), (None, "w3 w1"), (2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("id", F.col("id").cast(kind)).repartition(3)
    counted = vectors.counted_rows(df, "id", "text")
    key = lambda r: (r.term, r.n, r.df, tuple(r.seen))
    want = {key(r) for r in vectors.frequencies(vectors.unpacked_counts(counted)).collect()}
    some = vectors.summed_counts(counted, most)
    got = some.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.min(F.struct("id", "first")).alias("seen"))
    assert {key(r) for r in got.collect()} == want == {key(r) for r in vectors.frequencies(counted).collect()}
    assert vectors.frequencies(counted.limit(0)).count() == 0


def test_the_vocabulary_sorts_terms_of_tasks_not_of_texts(spark):
    """No term of a text is a row that Spark sorts: a sort of all of them spills once the texts are many."""
    from loreweave.plans import retrieval

    rng = random.Random(4)
    pool = [f"w{i}" for i in range(150)]
    docs = spark.createDataFrame([(i, " ".join(rng.sample(pool, 100))) for i in range(400)], "id long, text string").repartition(4)
    counted = vectors.counted_rows(docs, "id", "text")
    assert vectors.summed_counts(counted).count() <= 150 * counted.rdd.getNumPartitions()
    fitted = []
    vocabulary = vectors.vocabulary
    with pytest.MonkeyPatch.context() as m:
        m.setattr(vectors, "vocabulary", lambda *a: fitted.append(vocabulary(*a)) or fitted[-1])
        retrieval.Corpus.of(docs)
    assert "Generate" not in fitted[0]._jdf.queryExecution().executedPlan().toString()


SEARCHING = (
    "rerank_fallback", "stage_counters", "confidence", "context_priority", "dedup_variants", "isolated_scores", "rerank_lexical",
    "rerank_missing_scores", "rerank_shape", "rerank_text", "scoped_context_package", "scoped_results", "uncontaminated", "seed_sources",
)


@pytest.mark.parametrize("name", SEARCHING)
def test_queries_that_search_sort_terms_of_tasks(spark, sf, monkeypatch, name):
    """One vocabulary for the query, out of sums that tasks have made."""
    from loreweave.plans import assembly, queries  # noqa: F401

    fitted = []
    vocabulary = vectors.vocabulary
    monkeypatch.setattr(vectors, "vocabulary", lambda *a: fitted.append(vocabulary(*a)) or fitted[-1])
    queries.QUERIES[name](spark, sf)
    plan = fitted[0]._jdf.queryExecution().executedPlan().toString()
    assert len(fitted) == 1 and "MapInArrow" in plan and "Generate" not in plan


def test_one_search_for_scores_and_expected_rows(spark, sf, monkeypatch):
    """eval_isolated takes its hits from one search."""
    from loreweave.plans import assembly, queries

    searched = []
    hits = queries._hits
    monkeypatch.setattr(assembly, "_hits", lambda *a: searched.append(1) or hits(*a))
    queries.QUERIES["eval_isolated"](spark, sf)
    assert len(searched) == 1
