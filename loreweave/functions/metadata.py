"""Metadata from names and paths: ordered rules as one CASE each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Document types by words in a file name, the first that fits.
DOC_TYPES = (("api", "api"), ("flow", "flow"), ("hardware|config", "hardware_config"), ("guide", "guide"))


def first_match(text: Column, rules: Sequence[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """Label of the first pattern that a text (in lower case) holds, else otherwise or null."""
    low = F.lower(text)
    out = None
    for pattern, label in rules:
        out = F.when(low.rlike(pattern), label) if out is None else out.when(low.rlike(pattern), label)
    return F.lit(None).cast("string") if out is None else out.otherwise(F.lit(None).cast("string") if otherwise is None else otherwise)


def doc_type(name: Column) -> Column:
    return first_match(name, DOC_TYPES, F.lit("reference"))


def cascade(*sources: tuple[Column, Sequence[tuple[str, str]]], otherwise: Column) -> Column:
    """First label that any of the (text, rules) pairs gives, in order."""
    return F.coalesce(*[first_match(text, rules) for text, rules in sources], otherwise)


def with_tag(tags: Column, when: Column, tag: str) -> Column:
    """tags with one more where a condition holds, never twice."""
    return F.array_union(F.coalesce(tags, F.array().cast("array<string>")), F.when(when, F.array(F.lit(tag))).otherwise(F.array().cast("array<string>")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))


def safe_stem(name: Column) -> Column:
    """Lower case, runs of other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def scope_of(ecosystem: Column, software: Column, scopes: Sequence[tuple[str, str, str, str]]) -> Column:
    """(vendor, platform, software) of a document; null if the scopes (ecosystem, software, vendor, platform) have none such.

    A software of '' in scopes stands for documents that are common to all versions.
    """
    kind = "struct<vendor:string,platform:string,software:string>"
    s = F.coalesce(software, F.lit(""))
    return F.coalesce(*[F.when((ecosystem == e) & (s == v), F.struct(F.lit(vendor).alias("vendor"), F.lit(platform).alias("platform"), F.lit(v).alias("software")).cast(kind)) for e, v, vendor, platform in scopes], F.lit(None).cast(kind))


def scope_of_path(path: Column, parts: Sequence[tuple[str, str]]) -> Column:
    """Label of the first (part, label) that a path has as a folder or file name, whatever the case; else null."""
    own = F.split(F.lower(F.coalesce(path, F.lit(""))), "/")
    return F.coalesce(*[F.when(F.array_contains(own, part.lower()), label) for part, label in parts], F.lit(None).cast("string"))


def fits_whole(name: Column, patterns: Sequence[str]) -> Column:
    """Whether the whole of a name fits one of the patterns, whatever the case; null: no."""
    return F.coalesce(F.lower(name).rlike("^(?:" + "|".join(patterns) + ")$"), F.lit(False)) if patterns else F.lit(False)


def admitted(docs: DataFrame, scopes: DataFrame) -> DataFrame:
    """docs (vendor, platform, software, ...) that one of the scopes (vendor, platform, software, general) takes in.

    A scope takes its own software and, where general, what is common to all ('').
    Documents without a scope go. Scopes are a few rows of configuration; the join
    is on vendor and platform, and no scope multiplies a document.
    """
    return docs.alias("d").join(
        scopes.alias("s"),
        (F.col("d.vendor") == F.col("s.vendor")) & (F.col("d.platform") == F.col("s.platform")) & ((F.col("d.software") == F.col("s.software")) | (F.col("s.general") & (F.coalesce("d.software", F.lit("")) == ""))),
        "left_semi",
    )


def with_contents(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """docs (source_html, ...) with toc_parent_href and toc_child_hrefs of contents (href, parent_href, child_hrefs); none: '' and empty."""
    once = contents.groupBy(F.col("href").alias("source_html")).agg(F.max_by("parent_href", F.struct("pos")).alias("p"), F.max_by("child_hrefs", F.struct("pos")).alias("c")) if "pos" in contents.columns else contents.select(F.col("href").alias("source_html"), F.col("parent_href").alias("p"), F.col("child_hrefs").alias("c")).dropDuplicates(["source_html"])
    return docs.join(once, "source_html", "left").withColumn("toc_parent_href", F.coalesce("p", F.lit(""))).withColumn("toc_child_hrefs", F.coalesce("c", F.array().cast("array<string>"))).drop("p", "c")


def configured_scopes(settings: dict) -> list[tuple[str, str, str]]:
    """(vendor, platform, software) of a configuration: its scopes, or without any those of the enabled platforms and versions.

    settings: {"scopes": [{vendor, platform, software}], "platforms": {platform: {vendor, enabled, versions}}}.
    """
    given = [(s["vendor"], s["platform"], s.get("software", "")) for s in settings.get("scopes") or ()]
    if given:
        return given
    return [(p["vendor"], name, v) for name, p in (settings.get("platforms") or {}).items() if p.get("enabled", True) for v in p.get("versions", ())]
