"""Line dedup: two Bloom filters find suspects, only suspects shuffle.

1. A pass over all lines sends the hashes of their keys (8 bytes each) to pieces
   dealt by hash. Of a hash that a task has in several documents one goes to its
   piece, marked; the others, suspects already, are dealt out by their row.
2. A piece has a filter of hashes seen once and one of those seen again. Once both
   are full it names the hashes that the second one knows, packed by the partition
   of their document, where they become one row for each document.
3. Documents are joined with their suspects, and only suspected keys are sent on,
   once a task; a grouping on the key itself confirms them exactly and picks the
   first document, so a false positive costs a row and never a line.

Filters grow with their pieces and pieces with the partitions, so at any size of
the corpus a filter has the same number of bits a hash, and none is broadcast. A
line with over a thousandth of the suspect rows is joined in parts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import byte_rows, packed, partitions, real_id, stored, texts, unpacked
from loreweave.llm.hashing import mixed

PROBES, BITS_PER_HASH = 4, 16
#: Hashes that a task holds before it sends them on.
HELD = 1 << 19
#: Lines with over this share of suspect rows, and so many, are joined in SALTS parts.
HOT_SHARE, HOT, SALTS = 0.001, 64, 16


def key_of(line: bytes, least: int) -> bytes | None:
    """Stripped and lower-cased (A-Z); None if it has under least code points."""
    key = line.strip().lower()
    n = len(key)
    if n < least or n < 4 * least and sum(b & 0xC0 != 0x80 for b in key) < least:
        return None
    return key


class Filter:
    """A Bloom filter of 64-bit hashes."""

    def __init__(self, hashes: int):
        self.bits = 1 << max(10, (hashes * BITS_PER_HASH - 1).bit_length())
        self.body = np.zeros(self.bits // 8, np.uint8)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, bit) of each hash's PROBES places, by double hashing."""
        at = (h[:, None] + np.arange(PROBES, dtype=np.uint64) * (mixed(h) | np.uint64(1))[:, None]) & np.uint64(self.bits - 1)
        return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        byte, bit = self.places(h)
        return (self.body[byte] & bit > 0).all(axis=1)

    def put(self, h: np.ndarray) -> None:
        byte, bit = self.places(h)
        np.bitwise_or.at(self.body, byte.ravel(), bit.ravel())


ALONE, SEVERAL, KNOWN = 0, 1, 2
ASKED = [("piece", pa.int32()), ("hashes", pa.binary()), ("rows", pa.binary()), ("states", pa.binary())]


def _by(bucket: np.ndarray):
    """(bucket, index array) of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    own, new = np.unique(bucket[order], return_index=True)
    return zip(own.tolist(), np.split(order, new[1:]), strict=True) if len(own) else ()


def _ask(pieces: int, least: int):
    def run(batches):
        hashes: list[int] = []
        docs: list[int] = []
        rows: list[int] = []

        def flush():
            h, doc, row = np.array(hashes, np.uint64), np.array(docs, np.int64), np.array(rows, np.int64)
            for x in (hashes, docs, rows):
                x.clear()
            order = np.lexsort((row, doc, h))
            h, doc, row = h[order], doc[order], row[order]
            same = np.concatenate(([False], h[1:] == h[:-1]))
            other = np.concatenate(([False], same[1:] & (doc[1:] != doc[:-1])))
            several = np.bincount(np.cumsum(~same) - 1, weights=other) > 0
            state = np.where(same, KNOWN, np.where(several[np.cumsum(~same) - 1], SEVERAL, ALONE)).astype(np.uint8)
            place = np.where(same, mixed(row.view(np.uint64) ^ h), mixed(h)) % np.uint64(pieces)
            out = [(p, packed(h[i]), packed(row[i]), state[i].tobytes()) for p, i in _by(place.astype(np.int64))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), ASKED, strict=True)], [x for x, _ in ASKED])

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for text, d, r in zip(byte_rows(batch.column("text")), batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), strict=True):
                own = {digest(k) for line in text.split(b"\n") if (k := key_of(line, least)) is not None}
                hashes += own
                docs += [d] * len(own)
                rows += [r] * len(own)
                if len(hashes) > HELD:
                    yield from flush()
        if hashes:
            yield from flush()

    return run


def suspects(runs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Of runs of (distinct hashes, states), which may be in two documents: the filters of one piece."""
    size = sum(len(h) for h, _ in runs)
    once, twice = Filter(size), Filter(size)
    for h, state in runs:
        first = state != KNOWN
        own = h[first]
        twice.put(own[once.has(own) | (state[first] == SEVERAL)])
        once.put(own)
    return [(state == KNOWN) | twice.has(h) for h, state in runs]


def _answer(homes: int):
    def run(batches):
        by_piece: dict[int, list] = {}
        for batch in batches:
            for piece, h, row, state in zip(*(batch.column(x).to_pylist() for x, _ in ASKED), strict=True):
                by_piece.setdefault(piece, []).append((unpacked(h, np.uint64), np.frombuffer(state, np.uint8), unpacked(row, np.int64)))
        for runs in by_piece.values():
            found = suspects([x[:2] for x in runs])
            h, row = (np.concatenate([x[i][ok] for x, ok in zip(runs, found, strict=True)]) for i in (0, 2))
            out = [(home, packed(row[i]), packed(h[i])) for home, i in _by((mixed(row.view(np.uint64)) % np.uint64(homes)).astype(np.int64))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["home", "rows", "hashes"])

    return run


def _suspects_by_row(batches):
    runs = [(unpacked(r, np.int64), unpacked(h, np.uint64)) for batch in batches for r, h in zip(*(batch.column(x).to_pylist() for x in ("rows", "hashes")), strict=True)]
    if runs:
        row, h = (np.concatenate(x) for x in zip(*runs, strict=True))
        own = list(_by(row))
        for low in range(0, len(own), 8192):
            some = own[low : low + 8192]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int64()), pa.array([h[i].tobytes() for _, i in some], pa.binary())], ["row", "hashes"])


SUSPECT = "key binary, first long, last long, docs array<long>, rids array<long>, lines array<array<int>>"


def _send(least: int):
    """A row for each suspected key of some documents, with all of them that hold it: a hot line is few rows."""

    def run(batches):
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            key, docs, rids, lines = zip(*((k, *x) for k, x in held.items()), strict=True)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((key, map(min, docs), map(max, docs), docs, rids, lines), kinds, strict=True)], [x.split()[0] for x in SUSPECT.split(", ")])

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            cols = (batch.column(x).to_pylist() for x in ("doc_id", "rid", "hashes"))
            for text, d, r, raw in zip(byte_rows(batch.column("text")), *cols, strict=True):
                some = set(np.frombuffer(raw, np.uint64).tolist())
                own: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split(b"\n")):
                    if (k := key_of(line, least)) is not None and digest(k) in some:
                        own.setdefault(k, []).append(i)
                for k, lines in own.items():
                    row = held.setdefault(k, [[], [], []])
                    for to, x in zip(row, (d, r, lines), strict=True):
                        to.append(x)
                    size += len(k) + 16 + 4 * len(lines)
                if size > 1 << 24:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _apply(batches):
    for batch in batches:
        n, dropped, kept = [], [], []
        for text, d, r, drop in zip(byte_rows(batch.column("text")), *(batch.column(x).to_pylist() for x in ("doc_id", "rid", "drop")), strict=True):
            lines = text.split(b"\n")
            n.append(len(lines))
            gone = {i for x in drop or () if x["doc_id"] == d and x["rid"] == r for i in x["lines"]}
            dropped.append(len(gone))
            kept.append(text if not gone else b"\n".join([x for i, x in enumerate(lines) if i not in gone]))
        own = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string(), safe=False), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), batch.column("carried"), *own], ["doc_id", "rid", "carried", "n_lines", "n_dropped", "kept_text", "kept_sha256"])


def _repeats(found: DataFrame) -> DataFrame:
    """(keep, m): the members m of suspect rows whose key a smaller document holds."""
    line = F.xxhash64("key")
    counts = found.groupBy(line.alias("line")).agg(F.count("*").alias("n"))
    total = found.count()
    hot = [r.line for r in counts.where(F.col("n") > max(HOT, int(total * HOT_SHARE))).select("line").collect()]  # under 1 / HOT_SHARE rows
    is_hot = line.isin(hot) if hot else F.lit(False)
    firsts = found.groupBy("key").agg(F.min("first").alias("keep"), F.max("last").alias("last")).where("keep < last").drop("last")
    firsts = firsts.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    dealt = found.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("first", "last", F.size("docs")), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    return dealt.join(firsts, ["key", "salt"]).select("keep", F.explode(F.arrays_zip("docs", "rids", "lines")).alias("m")).where("m.docs > keep")


def dedup_lines(docs: DataFrame, least_chars: int = 10, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, rid, carried, n_lines, n_dropped, kept_text, kept_sha256), a row for each row of docs.

    carried: a struct of the columns named in carry, as they are.

    A line's key is the line stripped of ASCII white space and with A-Z in lower
    case. A key of least_chars code points or more that at least two documents
    hold stays only in the one with the smallest doc_id, there in all its lines.

    Null or empty text: one empty line, kept. Null doc_id: after all others, and
    all such rows are one document. Rows with one doc_id are one document; each
    keeps a row of its own (rid is the hash of its text). Empty table: no rows.
    Other columns are ignored, so their names can't clash.
    """
    n = partitions(docs.sparkSession)
    rows = texts(docs, F.struct(F.lit(0).alias("_"), *carry).alias("carried")).withColumn("rid", F.xxhash64("text")).withColumn("row", F.xxhash64("doc_id", "rid"))
    carried = rows.schema["carried"].dataType.simpleString()
    asked = rows.select("doc_id", "row", "text").mapInArrow(_ask(n, least_chars), "piece int, hashes binary, rows binary, states binary")
    told = asked.repartitionById(n, F.col("piece")).mapInArrow(_answer(n), "home int, rows binary, hashes binary")
    hints = told.repartitionById(n, F.col("home")).mapInArrow(_suspects_by_row, "row long, hashes binary")
    found = stored(rows.select("doc_id", "rid", "row", "text").join(hints, "row").select("doc_id", "rid", "text", "hashes").mapInArrow(_send(least_chars), SUSPECT), "line-suspects")
    drops = _repeats(found).groupBy(F.xxhash64("m.docs", "m.rids").alias("row")).agg(F.collect_set(F.struct(F.col("m.docs").alias("doc_id"), F.col("m.rids").alias("rid"), F.col("m.lines").alias("lines"))).alias("drop"))
    out = rows.join(drops, "row", "left").select("doc_id", "rid", "carried", "text", "drop")
    return out.mapInArrow(_apply, f"doc_id long, rid long, carried {carried}, n_lines long, n_dropped long, kept_text string, kept_sha256 string").withColumn("doc_id", real_id("doc_id"))


def op9(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.i, k.line, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

