"""A table that changes by committed batches: data folders, and manifests that say which of them counts for a source.

    table/data/batch=<name>/   rows of the sources of one batch, never changed
    table/manifest/v=<n>/      (source, stamp, batch, version): what commit n changed; batch null: the source is gone
    table/errors/v=<n>-<name>/ (source, stamp, error): sources that a run could not take in

A commit is a manifest with its _SUCCESS file; a run that dies before it leaves a
data folder that nobody reads. The newest commit that names a source says where its
rows are, so a changed source's old rows go and its new ones come in one step.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators.store import changes
from loreweave.sources.shared import stored

MANIFEST = "source {kind}, stamp {stamp}, batch string, version long"
#: Sources that are taken in with one commit.
BATCH = 100_000


def committed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of tables that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    return sorted(x.getPath().getName() for x in fs.listStatus(top) if fs.exists(path(x.getPath(), "_SUCCESS")))


def _versions(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(x.removeprefix("v=")) for x in committed(spark, f"{table}/manifest"))


def state(spark: SparkSession, table: str, version: int | None = None) -> DataFrame | None:
    """(source, stamp, batch): the sources of the table as of a version (the last one by default); None before any commit."""
    found = [v for v in _versions(spark, table) if version is None or v <= version]
    if not found:
        return None
    rows = spark.read.parquet(*[f"{table}/manifest/v={v}" for v in found])
    last = rows.groupBy("source").agg(F.max_by(F.struct("stamp", "batch"), "version").alias("at"))
    return last.where("at.batch is not null").select("source", "at.stamp", "at.batch")


def commit(spark: SparkSession, table: str, told: DataFrame) -> int:
    """Makes told (source, stamp, batch) the newest version; its number."""
    version = max(_versions(spark, table), default=0) + 1
    # What a run that died has left under this number was never committed.
    told.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{table}/manifest/v={version}")
    return version


def read(spark: SparkSession, table: str, version: int | None = None) -> DataFrame | None:
    """The rows of the table's sources as of a version, with their source and batch."""
    known = state(spark, table, version)
    if known is None:
        return None
    batches = [r.batch for r in known.select("batch").distinct().collect()]  # a name a commit
    if not batches:
        return None
    rows = spark.read.option("basePath", f"{table}/data").parquet(*[f"{table}/data/batch={b}" for b in batches])
    return rows.withColumn("batch", F.col("batch").cast("string")).join(known.select("source", "batch"), ["source", "batch"], "left_semi")


def errors(spark: SparkSession, table: str) -> DataFrame | None:
    """(source, stamp, error) of the sources that the last run could not take in."""
    found = committed(spark, f"{table}/errors")
    run = max((int(x.split("-")[0].removeprefix("v=")) for x in found), default=None)
    return None if run is None else spark.read.parquet(*[f"{table}/errors/{x}" for x in found if x.startswith(f"v={run}-")])


def apply(
    files: DataFrame, table: str, rows_of: Callable[[DataFrame], DataFrame], fault: Column | None = None, batch: int = BATCH, isolate: bool = True,
) -> DataFrame:
    """Brings the table up to files (source, stamp, ...); one row (new, modified, deleted, rows, failed).

    rows_of: what the table holds of some files, with their source. fault: what is
    wrong with a file, null if nothing; such files go to the errors and are taken
    for new or modified again by the next run. Files are taken in by batches of some
    sources, each committed by itself: a run that dies is finished by the next one.
    isolate: a batch that fails goes to the errors, and the others go on.
    Null sources take no part; of repeated ones the latest stamp counts. Sources of
    later stamp are modified; those not among files are deleted first. No files:
    all sources go.
    """
    spark = files.sparkSession
    latest = files.where("source is not null").groupBy("source").agg(F.max("stamp").alias("stamp"))
    known = state(spark, table)
    if known is None:
        known = latest.withColumn("batch", F.lit("")).where(F.lit(False))
    what = stored(changes(latest, known.select("source", "stamp"), "source", "stamp"), "changes")
    counts = {r.change: r["count"] for r in what.groupBy("change").count().collect()}
    if counts.get("deleted"):
        gone = what.where("change = 'deleted'").join(known.select("source", "stamp"), "source")
        commit(spark, table, gone.select("source", "stamp", F.lit(None).cast("string").alias("batch")))

    n = counts.get("new", 0) + counts.get("modified", 0)
    parts = max(1, -(-n // batch))
    run = max((int(x.split("-")[0].removeprefix("v=")) for x in committed(spark, f"{table}/errors")), default=0) + 1
    changed = what.where("change <> 'deleted'").select("source").join(latest, "source")
    once = files.join(changed, ["source", "stamp"], "left_semi").dropDuplicates(["source"])
    once = stored(once.withColumn("_part", F.pmod(F.xxhash64("source"), F.lit(parts))).withColumn("_fault", (F.lit(None) if fault is None else fault).cast("string")), "changed-files")
    rows = failed = 0

    def refused(some: DataFrame, error: Column) -> None:
        some.select("source", "stamp", error.alias("error")).write.parquet(f"{table}/errors/v={run}-{uuid.uuid4().hex}")

    bad = once.where("_fault is not null")
    refused(bad, F.col("_fault"))
    failed += bad.count()
    for part in range(parts):
        some = once.where((F.col("_part") == part) & F.col("_fault").isNull())
        name = f"b{uuid.uuid4().hex}"
        try:
            rows_of(some.drop("_part", "_fault")).write.parquet(f"{table}/data/batch={name}")
        except Exception as e:
            if not isolate:
                raise
            refused(some, F.lit(f"{type(e).__name__}: {e}"[:500]))
            failed += some.count()
            continue
        commit(spark, table, some.select("source", "stamp", F.lit(name).alias("batch")))
        rows += spark.read.parquet(f"{table}/data/batch={name}").count()
    out = [(counts.get("new", 0), counts.get("modified", 0), counts.get("deleted", 0), rows, failed)]
    return spark.createDataFrame(out, "new long, modified long, deleted long, rows long, failed long")
