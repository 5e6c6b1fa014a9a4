"""A training corpus out of raw documents, in five stages of the corpus operators.

Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import line_dedup, mixing, near_shingles, quality, sentencepiece_codec
from loreweave.llm.common import NO_ID, partitions, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Rows of docs with what an operator says of them, by key (doc_id, null as NO_ID) and rid; rows it doesn't name go."""
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("key")
    rid = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("rid")
    return docs.select(*COLUMNS, key, rid).join(told.select(key, *[c for c in told.columns if c != "doc_id"]), ["key", "rid"])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts, null ids and repeated rows stay as they are; equal rows fare alike."""
    return quality.without_bad(docs.select(*COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go; documents stay, with an empty text if no line is left."""
    out = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the document of smallest id stays; of equal or no ids, the text of smallest hash.

    Near: a Jaccard similarity of 0.8 or more between the sets of five-word shingles.
    Null and empty texts are one group, of which one row stays. Rows repeated as they
    are: one. Empty table: no rows.
    """
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "rid")).alias("first")
    kept = near_shingles.near_shingles(docs).groupBy("component").agg(first).select("first.*")
    return _with(docs, kept).dropDuplicates(["key", "rid"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded to whole texts, in order of the mix's slots.

    A text comes once more where the mix takes half of it or more; the first text of
    a source's stream comes at least once, so a source of a few long texts keeps a
    place. So a source is off its target by half of the text where its stream ends,
    or by that first text. Null and empty texts have no words and are in no mix.
    Null ids and repeated rows: as other rows. Empty table: no rows.
    """
    times = F.greatest(F.round(F.col("taken") / F.col("size")), (F.col("start") == 0).cast("double"))
    told = mixing.mix(docs).where("taken > 0").groupBy("doc_id", "rid").agg(F.max(times).cast("int").alias("times"), F.min("first_slot").alias("low"), F.max("last_slot").alias("high")).where("times > 0")
    told = stored(told, "mix-slots")
    n, slots = partitions(spark), (told.agg(F.max("high")).first()[0] or 0) + 1
    copies = _with(docs, told).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    at = F.col("low") + F.floor((F.col("high") - F.col("low")) * F.col("copy") / F.greatest(F.lit(1), F.col("times") - 1))
    place = F.least(F.lit(n - 1), F.floor(F.col("slot") * n / slots)).cast("int")
    return copies.withColumn("slot", at).repartitionById(n, place).sortWithinPartitions("slot", "key", "rid").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether they decode to it. Null and empty texts: no pieces. A row for each row."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality filter", quality_filter),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("sentencepiece", encode),
]

#: Fingerprints, learned weights and the piece model have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
