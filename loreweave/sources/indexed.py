"""Tables laid out for what is asked of them: partitions, order and Bloom filters of Parquet, and scans that go on from a cursor.

Rows are dealt by ranges of the partition columns and the key and sorted within, so
files hold ranges of keys and their statistics rule most of them out. What a table
is partitioned by should have few values. A table's bounds, a row a file, say where
each file begins and ends; a scan from a cursor opens the files from there on only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write(rows: DataFrame, path: str, key: str, by: Sequence[str] = (), bloom: Sequence[str] = (), per_file: int = 1_000_000, files: int | None = None) -> None:
    """rows at path, partitioned by some columns, in order of key within; bloom: columns that are asked for single values.

    Written anew. Null keys come first. per_file: rows of a file, at most.
    """
    n = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(n, *by, key).sortWithinPartitions(*by, key).write.mode("overwrite").option("maxRecordsPerFile", str(per_file))
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(per_file))
    (out.partitionBy(*by) if by else out).parquet(path)


def files_read(df: DataFrame) -> int:
    """How many files the scans of df opened; runs it."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(s.metrics().apply("numFiles").value() for s in scans if s.metrics().contains("numFiles"))


@dataclass
class Scan:
    """A table that write() made, to be read page by page in order of its key; first and last: (file, first key, last key, rows)."""

    spark: SparkSession
    key: str
    bounds: list[tuple]
    schema: object

    def page(self, cursor: object = None, size: int = 1000) -> tuple[DataFrame, object]:
        """(the next size rows after cursor, the cursor after them); the cursor is None once all rows were given.

        Keys are unique and not null. Opens the files from the cursor on whose rows
        make a page.
        """
        ahead = [b for b in self.bounds if cursor is None or b[2] > cursor]
        chosen, held = [], 0
        for b in ahead:
            chosen.append(b[0])
            # Of a file that the cursor lies in, some rows have been given.
            held += b[3] if cursor is None or b[1] > cursor else 0
            if held >= size:
                break
        if not chosen:
            return self.spark.createDataFrame([], self.schema), None
        rows = self.spark.read.schema(self.schema).parquet(*chosen)
        rows = (rows if cursor is None else rows.where(F.col(self.key) > F.lit(cursor))).orderBy(self.key).limit(size)
        last = rows.agg(F.max(self.key).alias("last"), F.count("*").alias("n")).first()
        return rows, last["last"] if last.n == size and self.bounds[-1][2] > last["last"] else None


def scan(spark: SparkSession, path: str, key: str) -> Scan:
    """A scan over the table at path (not partitioned). Its bounds are a row a file."""
    rows = spark.read.parquet(path)
    found = rows.where(F.col(key).isNotNull()).groupBy(F.input_file_name().alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).orderBy("first")
    return Scan(spark, key, [tuple(r) for r in found.collect()], rows.schema)


def filtered(spark: SparkSession, path: str, predicate: Column) -> DataFrame:
    """Rows of the table at path that fit; partitions and files that can't hold any are not read."""
    return spark.read.parquet(path).where(predicate)
