"""Incremental maintenance with Structured Streaming: files in, keyed tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreweave.operators.store import first_of
from loreweave.sources.shared import shared_dir as work_dir  # noqa: F401 - where streams keep their tables


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder (or file pattern) of Parquet as a stream with the schema it has now."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files_per_trigger)).option("pathGlobFilter", "*.parquet").parquet(path)


def upsert_stream(stream: DataFrame, key: str, order: str, target: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Keeps the table at target (Parquet by bucket of the key) at the last row of each key, by order; ends when all input is read.

    A batch is a run of its own folder, written by batch id, so a batch that is
    done again after a failure replaces its own rows. read_latest() merges runs.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = first_of(batch, [key], [F.col(order).desc()])
        last.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets))).write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/run={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, target: str, key: str, order: str) -> DataFrame:
    """The last row of each key over all runs, by order, then by run."""
    rows = spark.read.parquet(target)
    return first_of(rows, [key], [F.col(order).desc(), F.col("run").desc()]).drop("run", "_bucket")


def windowed_counts(stream: DataFrame, stamp: str, by: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, by, n) of events in fixed windows; events later than the watermark are dropped by the stream."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, length), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
