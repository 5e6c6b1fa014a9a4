"""A table brought up to date by committed batches: crashes, faults, changes and deletions."""

import pytest
from pyspark.sql import functions as F

from loreweave.sources import versioned

FILE = "source string, stamp long, text string"


def words(df):
    return df.select("source", F.posexplode(F.split("text", " ")).alias("pos", "word"))


def held(spark, table, version=None):
    rows = versioned.read(spark, table, version)
    return [] if rows is None else sorted((r.source, r.pos, r.word) for r in rows.collect())


def want(rows):
    return sorted((s, i, w) for s, _, t in rows for i, w in enumerate(t.split(" ")))


def test_a_run_that_dies_in_its_second_batch_is_finished_by_the_next(spark, tmp_path):
    rows = [(f"f{i}", 1, f"a{i} b c{i}") for i in range(60)]
    files = spark.createDataFrame(rows, FILE)
    calls = []

    def dying(df):
        calls.append(1)
        if len(calls) == 2:
            # Half a batch is written when the job ends.
            return words(df).withColumn("word", F.when(F.col("pos") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("word")))
        return words(df)

    table, clean = str(tmp_path / "t"), str(tmp_path / "clean")
    with pytest.raises(Exception, match="lost"):
        versioned.apply(files, table, dying, batch=20, isolate=False).collect()
    after = held(spark, table)
    assert 0 < len(after) < 180 and len(versioned._versions(spark, table)) == 1
    first = versioned.apply(files, table, words, batch=20).first()
    assert (first.new, first.modified, first.deleted, first.failed) == (60 - len(after) // 3, 0, 0, 0) and first.rows == 180 - len(after)
    versioned.apply(files, clean, words, batch=20)
    assert held(spark, table) == held(spark, clean) == want(rows)
    assert tuple(versioned.apply(files, table, words).first()) == (0, 0, 0, 0, 0)


def test_a_batch_that_fails_is_set_apart_and_others_go_on(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = [(f"f{i}", 1, f"a b{i}") for i in range(40)]
    files = spark.createDataFrame(rows, FILE)

    def failing(df):
        return words(df).withColumn("word", F.when(F.col("word") == "b7", F.raise_error(F.lit("no"))).otherwise(F.col("word")))

    got = versioned.apply(files, table, failing, batch=10).first()
    lost = {r.source for r in versioned.errors(spark, table).collect()}
    assert "f7" in lost and got.failed == len(lost) < 40 and got.rows == 2 * (40 - len(lost))
    assert {s for s, *_ in held(spark, table)} == {s for s, *_ in rows} - lost
    again = versioned.apply(files, table, words).first()
    assert again.new == len(lost) and held(spark, table) == want(rows) and versioned.errors(spark, table).count() == 0


def test_changes_faults_and_versions(spark, tmp_path):
    table = str(tmp_path / "t")
    one = [("a", 1, "x y"), ("b", 1, "z"), ("c", 1, "bad"), (None, 1, "q"), ("d", 1, "old"), ("d", 2, "new words"), ("e", None, "t")]
    fault = F.when(F.col("text") == "bad", "unreadable")
    got = versioned.apply(spark.createDataFrame(one, FILE), table, words, fault).first()
    assert (got.new, got.modified, got.deleted, got.failed) == (5, 0, 0, 1)
    assert [tuple(r) for r in versioned.errors(spark, table).collect()] == [("c", 1, "unreadable")]
    assert held(spark, table)[:5] == want([("a", 1, "x y"), ("b", 1, "z"), ("d", 2, "new words")])
    two = [("a", 1, "never read"), ("b", 2, "z z"), ("c", 2, "fine now")]
    got = versioned.apply(spark.createDataFrame(two, FILE).withColumn("batch", F.lit(9)), table, words, fault).first()
    assert (got.new, got.modified, got.deleted, got.failed) == (1, 1, 2 if got.deleted == 2 else 1, 0)
    assert {s for s, *_ in held(spark, table)} == {"a", "b", "c"}
    assert held(spark, table) == want([("a", 1, "x y"), ("b", 2, "z z"), ("c", 2, "fine now")])
    # An earlier version is still there to be read.
    assert {s for s, *_ in held(spark, table, 1)} >= {"a", "b", "d"}
    versioned.apply(spark.createDataFrame([], FILE), table, words)
    assert held(spark, table) == []


def test_unfinished_manifests_do_not_count(spark, tmp_path):
    table = str(tmp_path / "t")
    versioned.apply(spark.createDataFrame([("a", 1, "x")], FILE), table, words)
    spark.createDataFrame([("a", 9, "none", 2)], "source string, stamp long, batch string, version long").write.parquet(f"{table}/manifest/v=2")
    (tmp_path / "t" / "manifest" / "v=2" / "_SUCCESS").unlink()
    assert held(spark, table) == [("a", 0, "x")]
    assert versioned.apply(spark.createDataFrame([("a", 2, "y")], FILE), table, words).first().modified == 1
    assert held(spark, table) == [("a", 0, "y")]
