"""Exact dedup: an extendible-hash index kept as files in the shared folder.

1. Each task groups the equal normalised texts of its rows (bytes compared) and
   writes one index entry for each: hash key, best row, member ids, the text. A
   hot text so takes an entry for each task, not for each row.
2. The directory comes from a histogram of the keys' leading bits: a bucket that
   holds more than its capacity splits, and the directory doubles where bits lack.
   Capacity grows with the entries so that the directory, which is broadcast,
   keeps to ``MAX_DEPTH`` bits.
3. Each owner task holds a range of neighbouring buckets, so a range of keys, with
   about the same number of entries. An owner chains the entries of one key and
   compares bytes along the chain, so colliding keys stay apart; what it finds is
   written to a file for each bucket.
4. A key with over a thousandth of all entries (there are fewer than a thousand)
   is chained in parts over all tasks first, and the owner gets a row of each part.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import byte_rows, partitions, real_id, shared_dir, stored, texts

SPACE = b" \t\n\x0b\x0c\r"
CAPACITY, MAX_DEPTH = 4096, 16
#: A key with over this share of all entries, and so many, is chained in parts first.
HOT_SHARE, HOT = 0.001, 256
#: Bytes of texts that a task groups before it writes entries.
HELD_BYTES = 1 << 24
ENTRY = "entry long, key long, sha string, n long, best_chars long, best_id long, members array<long>, body binary"
CHAIN = "key long, n long, best_chars long, best_id long, entries array<long>, body binary"


def normalised(text: bytes) -> bytes:
    return text.translate(None, SPACE)


def _entries(hash_bits: int, held_bytes: int = HELD_BYTES):
    def run(batches):
        base, count, size = TaskContext.get().partitionId() << 36, 0, 0
        held: dict[bytes, list] = {}

        def flush():
            rows = [(base + count + i, int.from_bytes(k[:8], "big", signed=True) >> (64 - hash_bits), k[:32].hex(), len(x[2]), -x[1][0], x[1][1], x[2], x[0]) for i, (k, x) in enumerate(held.items())]
            held.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.int64()), pa.binary()]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows[at : at + 4096], strict=True), kinds, strict=True)], [x.split()[0] for x in ENTRY.split(", ")])

        for batch in batches:
            for text, d in zip(byte_rows(batch.column("text")), batch.column("doc_id").to_pylist(), strict=True):
                body = normalised(text)
                chars = len(text) if text.isascii() else len(text) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
                rank = (-chars, d)
                digest = hashlib.sha256(body).digest()
                own = held.get(digest)
                if own is not None and own[0] != body:  # the digests of two texts are equal: a chain of its own
                    digest += body
                    own = held.get(digest)
                if own is None:
                    held[digest] = [body, rank, [d]]
                    size += len(body)
                else:
                    own[1] = min(own[1], rank)
                    own[2].append(d)
                    size += 8
                if size > held_bytes:
                    n = len(held)
                    yield from flush()
                    count, size = count + n, 0
        yield from flush()

    return run


def directory(counts: dict[int, int], depth_of_counts: int, capacity: int = CAPACITY, owners: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """(global depth, bucket of each slot, owner of each bucket): a bucket splits while it is overfull and bits are left.

    Owners get neighbouring buckets with about the same number of entries.

    counts: entries by the leading depth_of_counts bits of the key.
    """
    fine = np.zeros(1 << depth_of_counts, np.int64)
    for k, v in counts.items():
        fine[k] = v
    todo, leaves, depth = [(0, 0)], [], 0
    while todo:
        prefix, local = todo.pop()
        width = 1 << (depth_of_counts - local)
        if local < depth_of_counts and fine[prefix * width : (prefix + 1) * width].sum() > capacity:
            todo += [(2 * prefix + 1, local + 1), (2 * prefix, local + 1)]  # the left half comes out first: buckets are key ranges
        else:
            leaves.append((prefix, local))
            depth = max(depth, local)
    slots = np.zeros(1 << depth, np.int64)
    held = np.zeros(len(leaves))
    for bucket, (prefix, local) in enumerate(leaves):
        width = 1 << (depth - local)
        slots[prefix * width : (prefix + 1) * width] = bucket
        width = 1 << (depth_of_counts - local)
        held[bucket] = fine[prefix * width : (prefix + 1) * width].sum()
    middle = np.cumsum(held) - held / 2
    return depth, slots, np.minimum(middle * owners / max(1, held.sum()), owners - 1).astype(np.int64)


def _chained(batches):
    """Rows in order of their key: of those whose bytes are equal one row, with the entries of all."""
    key, chain = None, []

    def out():
        rows = [(key, g[1], -g[2][0], g[2][1], g[3], g[0]) for g in chain]
        if rows:
            kinds = [*[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in CHAIN.split(", ")])

    done: list[pa.RecordBatch] = []
    for batch in batches:
        cols = [batch.column(x).to_pylist() for x in ("key", "n", "best_chars", "best_id", "entries")]
        for k, n, chars, best, entries, body in zip(*cols, byte_rows(batch.column("body")), strict=True):
            if k != key:
                done += out()
                key, chain = k, []
            for g in chain:
                if g[0] == body:
                    g[1] += n
                    g[2] = min(g[2], (-chars, best))
                    g[3] += entries
                    break
            else:
                chain.append([body, n, (-chars, best), entries])
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
            done = []
    yield from out()


def _hashed_buckets(index: DataFrame, capacity: int, hash_bits: int) -> DataFrame:
    """(bucket, key, entry, keep_id, group_size), a row for each entry of the index: its bucket files, read back."""
    spark = index.sparkSession
    n = partitions(spark)
    # The key's leading bits; keys are signed, so the range is moved to start at 0.
    bits = min(MAX_DEPTH, hash_bits)
    lead = F.shiftright("key", hash_bits - bits) + F.lit(1 << (bits - 1))
    counts = {r.lead: r.n for r in index.groupBy(lead.alias("lead")).agg(F.count("*").alias("n")).collect()}  # 2^MAX_DEPTH rows at most
    total = sum(counts.values())
    depth, slots, owner = directory(counts, bits, max(capacity, total >> (MAX_DEPTH - 3)), n)
    table = spark.createDataFrame([(i, int(b), int(owner[b])) for i, b in enumerate(slots)], "slot long, bucket long, owner int")
    entries = index.select("key", "n", "best_chars", "best_id", F.array("entry").alias("entries"), "body")
    hot = [(r.key,) for r in index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(HOT, int(total * HOT_SHARE))).select("key").collect()]  # under 1 / HOT_SHARE rows
    if hot:
        keys = F.broadcast(spark.createDataFrame(hot, "key long"))
        parts = entries.join(keys, "key").repartition(n, "key", F.pmod(F.xxhash64("entries"), F.lit(n))).sortWithinPartitions("key").mapInArrow(_chained, CHAIN)
        entries = entries.join(keys, "key", "left_anti").unionByName(parts)
    placed = entries.withColumn("slot", F.shiftright(lead, bits - depth)).join(F.broadcast(table), "slot").drop("slot", "bucket")
    owned = placed.repartitionById(n, F.col("owner")).sortWithinPartitions("key").select("key", "n", "best_chars", "best_id", "entries", "body").mapInArrow(_chained, CHAIN)
    found = owned.select("key", F.explode("entries").alias("entry"), F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"))
    path = f"{shared_dir(spark)}/hash-buckets-{uuid.uuid4().hex}"
    found = found.withColumn("slot", F.shiftright(lead, bits - depth)).join(F.broadcast(table.drop("owner")), "slot").drop("slot")
    found.write.partitionBy("bucket").parquet(path)  # an owner's buckets are its own, so each is one file
    return spark.read.schema("key long, entry long, keep_id long, group_size long, bucket long").parquet(path)


def dedup_exact(docs: DataFrame, capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs.

    Texts are equal if identical without the characters [\\x20\\x09-\\x0D]. The
    row with most code points stays, then the smallest doc_id.

    Null text: empty, so all empty and white texts are one group. Null doc_id:
    after all others. Rows that repeat a doc_id are rows of their own; all rows
    with the doc_id that stays count as kept. Empty table: no rows. Other columns
    are ignored. hash_bits: fewer let keys collide, which costs comparisons only.
    """
    rows = texts(docs).select("doc_id", "text")
    index = stored(rows.mapInArrow(_entries(hash_bits), ENTRY), "hash-index")
    owned = _hashed_buckets(index, capacity, hash_bits).select("entry", "keep_id", "group_size")
    out = index.select("entry", "members", "sha").join(owned, "entry").select(F.explode("members").alias("doc_id"), "keep_id", "group_size", F.col("sha").alias("text_sha256"))
    return out.select(real_id("doc_id"), real_id("keep_id"), "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def op10(docs: DataFrame) -> DataFrame:
    return dedup_exact(docs)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
g AS (SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
