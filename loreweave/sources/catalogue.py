"""Vocabularies and symbol owners as tables that outlive a job, with the version of their form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 2
OWNERS = "symbol string, name string, scope string, sources array<string>"


def save(rows: DataFrame, path: str) -> None:
    """rows as a table at path, in place of what is there, with the form's version in each row."""
    rows.withColumn("format_version", F.lit(FORMAT)).write.mode("overwrite").parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path, None if there is none; one of an older form is refused."""
    rows = _read(spark, path)
    if rows is None:
        return None
    if "format_version" not in rows.columns or rows.where(F.coalesce("format_version", F.lit(0)) != FORMAT).limit(1).count():
        raise ValueError(f"{path} has another form than {FORMAT}; fit it anew")
    return rows.drop("format_version")


def load_owners(spark: SparkSession, path: str) -> DataFrame:
    """Symbol owners at path; without such a table none."""
    found = load(spark, path)
    return spark.createDataFrame([], OWNERS) if found is None else found


def fitted_once(spark: SparkSession, path: str, fit: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path, fitted first where there is none, or it is empty, or force says so."""
    found = None if force else load(spark, path)
    if found is None or found.isEmpty():
        save(fit(), path)
        found = load(spark, path)
    return found
