"""Mixing sources to target weights with a low-discrepancy schedule.

A source's documents form a stream, shuffled by a hash and cut into blocks of
equal tokens. Slot i of the mix takes the golden-ratio point frac(i * phi),
which the sources' cumulative slot counts map to a source; a slot's rank among
its source's slots says which block of the stream (and of which repetition) it
brings. A source gets no more slots than its quota needs, the last one trimmed;
the few that the points leave short come after the schedule's end, so a source
takes its target to the word. The schedule says when: a document has the first and
the last slot that bring words of it, and the mix is read in order of slots.

Ranks and stream positions are prefix sums in two levels (chunks, then rows in a
chunk), so neither a source with a third of all rows nor the schedule itself
meets in one task. Only the table of sources, a row each, is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.llm.common import real_id, stored, texts

GOLDEN = 0.6180339887498949
BLOCK_TOKENS, CHUNK = 4096, 1 << 16
SPACE = r"[\x20\x09-\x0D]"


def n_words(text: Column) -> Column:
    """Number of runs of characters that are not ASCII white space."""
    edges = ((text == "") | text.rlike(rf"\A{SPACE}")).cast("int") + text.rlike(rf"{SPACE}\z").cast("int")
    return (F.size(F.split(text, rf"{SPACE}+")) - edges).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for (source, source_size): weights go round by code point, null last.

    Targets share share of all sizes by weight; one above most times its size is
    cut to that and the rest reshared, which ends at min(most * size, level * weight).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")).cast("double")).withColumn("cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    ranked = ranked.withColumns({"below": F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "open": F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)), "all": F.sum("source_size").over(Window.partitionBy())})
    ranked = ranked.withColumn("level", (F.col("all") * share - F.col("below")) / F.col("open"))
    # Cutting the sources below one raises its level until none is above; from there on the levels fall.
    return ranked.withColumn("target", F.least("cap", F.max("level").over(Window.partitionBy()) * F.col("weight"))).select("source", "source_size", "target")


def schedule(quotas: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(slot, sid, block, epoch, take): the mix, a row for each block that it brings.

    quotas: (sid, source_size, quota), sid from 0 without gaps, a row for each source.
    """
    spark = quotas.sparkSession
    rest = F.col("quota") - F.col("epochs") * F.col("source_size")
    q = quotas.where("source_size > 0 and quota > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block_tokens)).withColumn("epochs", F.floor(F.col("quota") / F.col("source_size")))
    q = q.withColumn("slots", F.col("epochs") * F.col("n_blocks") + F.ceil(rest / block_tokens))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("high", F.sum("slots").over(upto)).withColumn("low", F.col("high") - F.col("slots"))
    n = q.agg(F.sum("slots")).first()[0] or 0
    points = spark.range(1, n + 1).select((F.col("id") - 1).alias("slot"), F.floor((F.col("id") * GOLDEN) % 1.0 * n).cast("long").alias("at"))
    # A point falls in the source whose [low, high) holds it: joined by coarse cell, then by range.
    cells = F.greatest(F.lit(1), F.lit(n) / 1024)
    ranges = q.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cells), F.floor((F.col("high") - 1) / cells))).alias("cell"))
    drawn = points.withColumn("cell", F.floor(F.col("at") / cells)).join(ranges, "cell").where("at >= low and at < high").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    chunks = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n"))
    ranked = drawn.withColumn("own", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(chunks.drop("n"), ["sid", "chunk"]).select("slot", "sid", (F.col("base") + F.col("own")).alias("rank"))
    got = chunks.groupBy("sid").agg(F.sum("n").alias("got"))
    short = q.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots").select("sid", F.explode(F.expr("sequence(got, slots - 1)")).alias("rank")).select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank")
    out = ranked.unionByName(short).join(q, "sid").where("rank < slots")
    out = out.withColumn("block", F.col("rank") % F.col("n_blocks")).withColumn("epoch", F.floor(F.col("rank") / F.col("n_blocks")))
    start = F.col("epoch") * F.col("source_size") + F.col("block") * block_tokens
    end = F.least(start + block_tokens, (F.col("epoch") + 1) * F.col("source_size"), F.col("quota"))
    return out.select("slot", "sid", "block", "epoch", (end - start).alias("take"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, rid, size, source_size, target, taken, first_slot, last_slot, start), a row for each row of docs.

    taken: words that the mix takes, repeats counted; first_slot, last_slot: of the
    schedule's slots that bring some (null: none); start: the text's place in its
    source's stream of words.

    Null or empty text: size 0, taken 0, no slots. Null source: a source of its own, last.
    Null doc_id: a row like any other. Repeated rows: each takes its own part of
    the stream. Empty table: no rows. Sources without words: target 0. Other
    columns are ignored. Reruns agree: the order is a hash of doc_id and text.
    """
    rows = texts(docs, F.col("source").cast("string").alias("source")).withColumns({"size": n_words(F.col("text")), "rid": F.xxhash64("text")})
    rows = rows.withColumn("h", F.md5(F.concat(F.lit("mix:"), F.col("doc_id").cast("string"))))
    rows = stored(rows.select("doc_id", "rid", "size", "source", "h"), "mix-sizes")
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    sizes = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("quota", F.round("target").cast("long"))
    sizes = stored(sizes, "mix-sources")
    rows = rows.join(sizes, rows.source.eqNullSafe(sizes.source)).select("doc_id", "rid", "size", "h", "sid", "source_size", "target", F.substring("h", 1, 3).alias("chunk"))
    bases = rows.groupBy("sid", "chunk").agg(F.sum("size").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).drop("n")
    own = Window.partitionBy("sid", "chunk").orderBy("h", "doc_id", "rid")
    # Rows alike in all that orders them get different places by row number, not by a running sum over peers.
    rows = rows.withColumn("own", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(own)).join(bases, ["sid", "chunk"]).withColumn("start", F.col("base") + F.col("own"))
    rows = stored(rows.select("doc_id", "rid", "size", "sid", "source_size", "target", "start"), "mix-stream")
    words = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("size") - 1) / block_tokens))))
    first = F.col("block") * block_tokens
    low, high = F.greatest("start", first) - first, F.least(F.col("start") + F.col("size"), first + block_tokens) - first
    words = words.select("sid", "start", "block", low.alias("low"), high.alias("high"))
    plan = schedule(sizes.select("sid", "source_size", "quota"), block_tokens).groupBy("sid", "block", "take").agg(F.count("*").alias("times"), F.min("slot").alias("first"), F.max("slot").alias("last"))
    brought = words.join(plan, ["sid", "block"]).withColumn("own", F.least("high", "take") - F.col("low")).where("own > 0")
    taken = brought.groupBy("sid", "start").agg(F.sum(F.col("own") * F.col("times")).alias("got"), F.min("first").alias("first_slot"), F.max("last").alias("last_slot"))
    keyed = rows.withColumn("place", F.when(F.col("size") > 0, F.col("start")))  # documents without words share a place
    return keyed.join(taken.withColumnRenamed("start", "place"), ["sid", "place"], "left").select(real_id("doc_id"), "rid", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "first_slot", "last_slot", keyed.start)


def op7(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("rid", "start")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER ()::DOUBLE AS total FROM w),
v AS (SELECT max((total * 1.5::DOUBLE - below) / open) AS level FROM r),
t AS (SELECT source, source_size, least(cap, level * weight) AS target, round(least(cap, level * weight))::BIGINT AS quota FROM r, v),
p AS (SELECT d.doc_id, d.size, t.source, t.source_size, t.target,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (source_size + 4095) // 4096 AS n_blocks, quota // source_size * ((source_size + 4095) // 4096) + (quota % source_size + 4095) // 4096 AS slots FROM t WHERE source_size > 0 AND quota > 0),
c AS (SELECT *, sum(slots) OVER (ORDER BY source NULLS LAST) AS high, sum(slots) OVER (ORDER BY source NULLS LAST) - slots AS low, sum(slots) OVER ()::BIGINT AS n FROM q),
i AS (SELECT unnest(range(1, (SELECT max(n) FROM c) + 1)) AS id, (SELECT max(n) FROM c) AS n),
g AS (SELECT id - 1 AS slot, floor((id * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE * n) AS spot FROM i),
k AS (SELECT c.source, slot, row_number() OVER (PARTITION BY c.source ORDER BY slot) - 1 AS rank FROM g JOIN c ON g.spot >= c.low AND g.spot < c.high),
e AS (SELECT source, slot, rank FROM k UNION ALL
      SELECT source, n + rank, rank FROM (SELECT c.source, c.n, unnest(range((SELECT count(*) FROM k WHERE k.source IS NOT DISTINCT FROM c.source), c.slots)) AS rank FROM c)),
b AS (SELECT e.source, slot, rank % n_blocks AS block, least(rank // n_blocks * source_size + rank % n_blocks * 4096 + 4096, (rank // n_blocks + 1) * source_size, quota) - (rank // n_blocks * source_size + rank % n_blocks * 4096) AS take
      FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source WHERE rank < slots),
w2 AS (SELECT doc_id, source, start, size, unnest(range(start // 4096, (start + size - 1) // 4096 + 1)) AS block FROM p WHERE size > 0),
o AS (SELECT doc_id, sum(own) AS taken, min(slot) AS first_slot, max(slot) AS last_slot
      FROM (SELECT w2.doc_id, slot, least(least(start + size, (w2.block + 1) * 4096) - w2.block * 4096, take) - (greatest(start, w2.block * 4096) - w2.block * 4096) AS own
            FROM w2 JOIN b ON w2.block = b.block AND w2.source IS NOT DISTINCT FROM b.source) WHERE own > 0 GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot, last_slot::BIGINT AS last_slot
FROM p LEFT JOIN o ON p.doc_id = o.doc_id
"""
