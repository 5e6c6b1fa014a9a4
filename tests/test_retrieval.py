"""The composed plans on corpora small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from loreweave.operators import evaluation, results, vectors
from loreweave.operators.routing import PlanRules
from loreweave.plans import retrieval

DOC = "id long, text string, source string, scope string, kind string, parent_id long"
RULES = PlanRules(ecosystems=(("alpha", ("alpha",)), ("closed", ("secret",))), versions=(("alpha", (("a1", ("a1",)), ("a2", ("a2",)))),), vague=(("alpha", ("software",)),), disabled=("closed",), broad=("overview",))
DOCS = [
    (1, "Pin levels\nalpha pin levels of a1 are set with setlevel and checked later on.", "one", "a1", "document", None),
    (2, "Pin levels again\nalpha pin levels of a2 are set with other commands, see there.", "two", "a2", "document", None),
    (3, "Common\nalpha pin levels are common to all of them, whatever the version is.", "three", "", "section", None),
    (4, "Else\nnothing of that kind is told here, only some other words.", "four", "a1", "section", None),
    (5, "Detail\nsetlevel takes a pin and a voltage.", "one", "a1", "paragraph", 1),
]


def docs(spark):
    return spark.createDataFrame(DOCS, DOC)


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query long, text string")


def found(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r.query, []).append(r)
    return out


def test_plans_filter_scopes_and_leave_out_blocked_and_ambiguous_queries(spark):
    q = asked(spark, (1, "alpha a1 pin levels"), (2, "secret pin levels"), (3, "alpha software pin"), (4, "pin levels"), (5, None))
    got = found(retrieval.retrieve_planned(q, docs(spark), RULES))
    assert set(got) == {1, 4}
    assert {1, 3} <= {r.id for r in got[1]} <= {1, 3, 4, 5}
    assert {1, 2, 3} <= {r.id for r in got[4]} and all(r.dropped == 0 for rows in got.values() for r in rows)
    assert [r["rank"] for r in got[1]] == list(range(1, len(got[1]) + 1))


def test_small_chunks_bring_their_parents(spark):
    got = found(retrieval.retrieve_planned(asked(spark, (1, "voltage")), docs(spark), RULES))
    assert {r.id for r in got[1]} == {1, 5}


def test_a_glossary_expands_and_broad_queries_take_their_own_way(spark):
    glossary = spark.createDataFrame([(1, ["volts"], ["voltage"], None, None, None)], "entry long, terms array<string>, expansions array<string>, ecosystem string, software string, family string")
    got = found(retrieval.retrieve_planned(asked(spark, (1, "volts"), (2, "overview of pin levels")), docs(spark), RULES, glossary))
    assert {r.id for r in got[1]} == {1, 5} and not got[1][0].broad and got[2][0].broad


def test_a_query_whose_reranker_failed_keeps_its_order(spark):
    judged = spark.createDataFrame([(q, i, i, float(i), False) for q in (1, 2) for i in (1, 2, 3)], "query long, id long, pos int, score double, low boolean")
    failed = spark.createDataFrame([(2, "timeout")], "query long, error string")
    got = found(retrieval.reranked(judged, 2, failed))
    assert [r.id for r in got[1]] == [3, 2] and [r.id for r in got[2]] == [1, 2]
    low = judged.withColumn("low", F.col("id") == 3)
    assert [r.id for r in found(retrieval.reranked(low, 3))[1]] == [2, 1, 3]  # useless ones last


def test_queries_without_a_known_term_take_dense_candidates_by_their_words(spark):
    d = docs(spark).select("id", "text")
    vecs = spark.createDataFrame([(9, [1.0, 0.0]), (1, [0.1, 1.0]), (2, [1.0, 0.2]), (3, [1.0, 0.1]), (8, [0.0, 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(9, "setlevel checked"), (8, "levels")], "id long, text string")
    counts = vectors.term_counts(d, "id", "text")
    corpus = retrieval.Corpus(counts, vectors.vocabulary(counts, 5).where("term = 'levels'"))
    got = found(retrieval.searched(q, d, corpus, vecs, 3))
    assert [r.id for r in got[9]][:2] == [1, 3] or [r.id for r in got[9]][0] in (1, 3)
    sparse_only = found(retrieval.searched(q, d, corpus, None, 3))
    assert set(sparse_only) == {8}


@pytest.mark.parametrize("wanted", [None, "a1"])
def test_in_scopes(spark, wanted):
    rows = spark.createDataFrame([(1, 1, "a1"), (1, 2, ""), (1, 3, None), (1, 4, "a2")], "query long, id long, scope string")
    out = results.in_scopes(rows, F.col("scope"), F.lit(wanted).cast("string"))
    assert sorted(r.id for r in out.collect()) == ([1, 2, 3] if wanted else [2, 3])


def test_one_bad_question_in_fifty_is_reported_and_the_others_are_scored(spark):
    def score(query, id_):
        if query == 7 and id_ == 2:
            raise KeyError("missing")
        return 1.0 / (query + id_)

    rows = spark.createDataFrame([(q, i) for q in range(50) for i in (1, 2, 3)], "query long, id long").repartition(3)
    scored = evaluation.isolated(rows, ("query", "id"), score)
    good, bad = evaluation.run(scored, rows.where("id = 2"), (1, 2))
    assert [(r.query, r.error, r.failed) for r in bad.collect()] == [(7, "KeyError: 'missing'", 1)]
    told = {(r.query, r.k): r.hit for r in good.collect()}
    assert {q for q, _ in told} == set(range(50)) - {7} and all(told[q, 1] == 0.0 and told[q, 2] == 1.0 for q in range(50) if q != 7)
    assert evaluation.isolated(rows.limit(0), ("query",), score).count() == 0


def test_counters_count_what_passes(spark):
    seen = evaluation.Counters()
    rows = seen.at("all", spark.range(100), most=F.max("id"))
    rows = seen.at("even", rows.where("id % 2 = 0"))
    assert rows.count() == 50 and seen.values() == {"all": {"n": 100, "most": 99}, "even": {"n": 50}}
    with pytest.raises(ValueError):
        seen.at("even", rows)


def test_candidates_hold_all_representatives(spark):
    from loreweave.operators import broad

    rows = [(i, f"s{i % 3}", "document" if i % 20 < 2 else "section" if i % 2 else "paragraph", "x" * (i * 7 % 40) * 500, i % 4 == 0, float(i % 5)) for i in range(120)]
    chunks = spark.createDataFrame(rows, "id long, source string, kind string, content string, low boolean, bonus double")
    some = broad.candidates(chunks)
    assert some.count() <= 3 * 7
    got, want = (sorted(map(tuple, broad.representatives(x).collect())) for x in (chunks.join(some, "id", "left_semi"), chunks))
    assert got == want and want
