"""Table operators: filters, lookups, pages, related rows, changes and upserts."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def predicate(filters: dict[str, object], skip: tuple[str, ...] = (), arrays: tuple[str, ...] = ()) -> Column:
    """All of the filters: a list means any of its values; a column of arrays matches by any element. No filters: true."""

    def one(name: str, want: object) -> Column:
        values = list(want) if isinstance(want, (list, tuple, set)) else [want]
        if name in arrays:
            return F.arrays_overlap(F.col(name), F.array(*map(F.lit, values)))
        return F.col(name).isin(values) if len(values) > 1 else F.col(name) == values[0]

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in filters.items() if k not in skip], F.lit(True))


def in_scope(vendor: str, platform: str, software: str) -> Column:
    """Rows of a scope: its own version, or what is common to all versions (empty software)."""
    return (F.col("vendor") == vendor) & (F.col("platform") == platform) & F.col("software").isin(software, "")


def lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(query, nth, key, rows' columns) for (query, ids array): in the array's order, repeats too, null columns where nothing is found."""
    asked = ids.select("query", F.posexplode("ids").alias("nth", key))
    return asked.join(rows, key, "left")


def page(rows: DataFrame, by: list[str], key: str, offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit of each group in order of key, with total, has_more and next_offset."""
    group = Window.partitionBy(*by)
    out = rows.withColumn("nth", F.row_number().over(group.orderBy(key))).withColumn("total", F.count("*").over(group))
    more = F.col("total") > offset + limit
    return out.where((F.col("nth") > offset) & (F.col("nth") <= offset + limit)).withColumn("has_more", more).withColumn("next_offset", F.when(more, offset + limit))


def expand_family(hits: DataFrame, rows: DataFrame, most_siblings: int = 2) -> DataFrame:
    """(query, id, relation, rank): hits (query, id, pos), then each hit's parent and first siblings, each id once.

    rows: (id, parent, place). A row whose place is 0 is its family's parent.
    """
    mine = hits.join(rows, "id")
    up = rows.where("place = 0").select("parent", F.col("id").alias("other"))
    parent = mine.where("place > 0").join(up, "parent").select("query", F.col("other").alias("id"), F.lit(1).alias("kind"), "pos", F.lit(0).alias("place"))
    others = rows.where("place > 0").select("parent", F.col("id").alias("other"), F.col("place").alias("other_place"))
    near = mine.where("place > 0").join(others, "parent").where("other <> id")
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("query", "pos").orderBy("other_place"))).where(F.col("nth") <= most_siblings)
    near = near.select("query", F.col("other").alias("id"), F.lit(2).alias("kind"), "pos", F.col("other_place").alias("place"))
    first = hits.select("query", "id", F.lit(0).alias("kind"), "pos", F.lit(0).alias("place"))
    key = F.struct(F.when(F.col("kind") == 0, 0).otherwise(1).alias("part"), "pos", "kind", "place")
    once = first.unionByName(parent).unionByName(near).groupBy("query", "id").agg(F.min(key).alias("at"))
    relation = F.element_at(F.array(F.lit("hit"), F.lit("parent"), F.lit("sibling")), F.col("at.kind") + 1)
    return once.select("query", "id", relation.alias("relation"), F.row_number().over(Window.partitionBy("query").orderBy("at")).alias("rank"))


def first_of(rows: DataFrame, by: list[str], order: list, most: int = 1) -> DataFrame:
    """The first most rows of each group."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_nth") <= most).drop("_nth")


def changes(current: DataFrame, state: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, change): new, modified (a later stamp) or deleted; rows without change are left out."""
    c = current.select(key, F.col(stamp).alias("now"), F.lit(True).alias("here"))
    s = state.select(key, F.col(stamp).alias("then"), F.lit(True).alias("known"))
    what = F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("now") > F.col("then"), "modified")
    return c.join(s, key, "full").select(key, what.alias("change")).where("change is not null")


def upsert(table: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """table with the batch's rows in place of those of equal key; of a batch's equal keys the last by order counts."""
    last = first_of(batch, [key], [F.col(order).desc()])
    return table.join(last.select(key), key, "left_anti").unionByName(last)


def deleted(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """table without the rows whose key is in gone."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, and the sorted distinct values of each column (of columns with few of them)."""
    return rows.agg(F.count("*").alias("n"), *[F.array_sort(F.collect_set(c)).alias(c) for c in columns])


def checked(rows: DataFrame, schema: dict[str, str], width: int | None = None, vector: str = "embedding") -> DataFrame:
    """rows, once their columns have the given types; raises otherwise. Vectors of another width fail when they are read."""
    have = dict(rows.dtypes)
    wrong = {k: have.get(k) for k, v in schema.items() if have.get(k) != v}
    if wrong:
        raise ValueError(f"columns differ from the schema: {wrong}")
    if width is None:
        return rows
    fine = F.col(vector).isNull() | (F.size(vector) == width)
    return rows.withColumn(vector, F.when(fine, F.col(vector)).otherwise(F.raise_error(F.lit("vector of another width"))))


def profile_key(settings: dict[str, object]) -> str:
    """Sixteen hex digits that name an ingestion profile; any setting that changes gives another."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def needs_rebuild(known: DataFrame | None, key: str) -> bool:
    """Whether a state table (profile, ...) is missing, empty, or of another profile than key."""
    return known is None or known.where(F.col("profile") == key).isEmpty()


def all_current(files: DataFrame, key: str) -> DataFrame:
    """The state after a full build: every file (path, stamp) as it is now, under the profile key."""
    return files.groupBy("path").agg(F.max("stamp").alias("stamp")).withColumn("profile", F.lit(key))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """(column, n): rows by kind; null is a kind."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))
