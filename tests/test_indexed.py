"""Tables laid out by partitions, order and filters: what is read, and pages from cursors."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loreweave.sources import indexed


def table(spark, n=4000):
    rows = [(i, ("en", "de", "fr", None)[i % 4], f"s{i % 50}") for i in random.Random(2).sample(range(10 * n), n)]
    return spark.createDataFrame(rows, "id long, lang string, source string")


def test_filters_reach_partitions_and_files(spark, tmp_path):
    df, path = table(spark), str(tmp_path / "t")
    indexed.write(df, path, "id", ("lang",), ("source",), per_file=100, files=8)
    whole = spark.read.parquet(path)
    some = indexed.filtered(spark, path, (F.col("lang") == "de") & F.col("id").between(1000, 3000) & (F.col("source") == "s7"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang" in plan and "GreaterThanOrEqual(id,1000)" in plan
    assert sorted(map(tuple, some.select("id", "lang", "source").collect())) == sorted(tuple(r) for r in df.collect() if r.lang == "de" and 1000 <= r.id <= 3000 and r.source == "s7")
    assert indexed.files_read(some) < indexed.files_read(whole) / 3
    one = next((tmp_path / "t" / "lang=de").glob("*.parquet"))
    meta = pq.ParquetFile(one).metadata.row_group(0)
    assert meta.column(0).statistics.has_min_max and meta.num_rows <= 100
    spans = sorted((m.column(0).statistics.min, m.column(0).statistics.max) for f in (tmp_path / "t" / "lang=de").glob("*.parquet") for m in [pq.ParquetFile(f).metadata.row_group(0)])
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))  # files hold ranges of keys


def test_pages_chained_by_cursor_are_the_whole_table(spark, tmp_path):
    df, path = table(spark, 1000), str(tmp_path / "t")
    indexed.write(df, path, "id", per_file=120, files=5)
    scan = indexed.scan(spark, path, "id")
    got, cursor, opened = [], None, []
    while True:
        rows, cursor = scan.page(cursor, 150)
        opened.append(indexed.files_read(rows))
        got += [r.id for r in rows.collect()]
        if cursor is None:
            break
    assert got == sorted(r.id for r in df.collect()) and len(got) == 1000
    assert max(opened) <= 4 < len(scan.bounds)  # a page opens its own files only
    early = {b[0] for b in scan.bounds[:2]}
    late, _ = scan.page(scan.bounds[-2][2], 10)
    assert not early & {r.f for r in late.select(F.input_file_name().alias("f")).collect()} and indexed.files_read(late) == 1


def test_pages_of_empty_tables_and_of_exact_size(spark, tmp_path):
    df = table(spark, 100)
    indexed.write(df.limit(0), str(tmp_path / "e"), "id")
    rows, cursor = indexed.scan(spark, str(tmp_path / "e"), "id").page()
    assert rows.count() == 0 and cursor is None
    indexed.write(df, str(tmp_path / "t"), "id", files=2)
    rows, cursor = indexed.scan(spark, str(tmp_path / "t"), "id").page(None, 100)
    assert rows.count() == 100 and cursor is None
