"""Removal of long repeated byte strings with a logarithmic family of suffix arrays.

What counts is whether the 100 bytes from a place (a *window*: a suffix cut to
the match length) also start earlier. Sorting all suffixes of the corpus would
move each byte a hundredfold, so candidates are narrowed first. Hashes only say
which windows can't repeat; that one does is said by its bytes.

1. Anchors. A window's anchor is its least 32-byte hash, a property of its bytes
   alone. Neighbouring windows with one anchor form a segment (about 35 windows),
   and equal windows have equal anchors. A row for each segment goes to where its
   anchor lives; an anchor found once is done: none of its windows repeats.
   Segments of a crowded anchor, each distinct one of a task, are narrowed again
   by the hashes of their windows and trimmed to those that repeat. What is left
   of a hot passage is then alike in all texts, a row for each task.
2. Index families. The bytes of what is left go to owner tasks. An owner takes
   batch after batch: a batch gets a suffix array (its windows in order of their
   bytes), which is merge-scanned against each level for common prefixes of the
   match length; of two equal windows the later is reported and the earlier stays;
   levels of equal size merge, so a window moves a logarithmic number of times.
   There are as many owners as keep each one's arrays under a bound.
3. Reports travel packed by the partition of their document, as runs of places,
   and become one row for each document; documents are joined with them, and bytes
   are removed.

Equal segments of a task's documents are settled there (bytes compared), so a hot
passage is a row for each task. Of an anchor that a task has several times, one
row goes home; the others, known to repeat, are dealt out by their place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import blocks, byte_rows, packed, partitions, real_id, stored, texts, unpacked, utf8
from loreweave.llm.hashing import Spans, mixed, sliding_min

GRAM = 32
CHUNK = 1 << 20
#: Segments that a task holds before it sends them on, bytes of segments, and windows.
HELD, HELD_BYTES, HELD_WINDOWS = 1 << 20, 1 << 25, 1 << 18
#: Windows that an owner gets, about.
OWNED = 1 << 21
#: An anchor is crowded if it has half as many segments as a partition has of all anchors, and so many.
CROWD = 4096
PLACE = np.dtype([("low", "<i4"), ("n", "<i4"), ("key", "<u8")])
RUN = np.dtype([("low", "<i4"), ("n", "<i4")])


def _blobs(order_key: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """data in order of order_key, one binary value for each distinct key."""
    order = np.argsort(order_key, kind="stable")
    key, data = order_key[order], data[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = (np.append(new, len(key)) * data.dtype.itemsize).astype(np.int32)
    return key[new], pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def segments(buf: np.ndarray, at: np.ndarray, match: int) -> tuple[np.ndarray, ...]:
    """(doc, low, n, anchor, again) of the segments of the texts between the offsets at.

    doc: index of the text; low: first window in buf; n: windows; again: the
    anchor occurs at several places of the segment.
    """
    n = len(buf) - match + 1
    if n <= 0:
        return tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.int64, np.uint64, bool))
    grams = Spans(buf).every(GRAM)
    place = np.uint64((1 << 21) - 1)
    least = sliding_min((grams & ~place) | np.arange(len(grams), dtype=np.uint64), match - GRAM + 1)
    spot = (least & place).astype(np.int64)
    key = grams[spot]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    inside = np.arange(match, n + match) <= at[doc + 1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (key[1:] != key[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | (key[1:] != key[:-1])
    low, high = np.flatnonzero(first), np.flatnonzero(last)
    return doc[low], low, high - low + 1, key[low], spot[low] != spot[high]


def _chunks(batches, match: int, chunk: int):
    """(ids, buf, at, base): texts of a slice; a very long text comes in overlapping chunks from base on."""
    for part in blocks(batches, most=chunk):
        buf, at = utf8(part.column("text"))
        ids = part.column("doc").to_numpy(zero_copy_only=False)
        if len(buf) <= chunk:
            yield ids, buf, at, 0
        else:  # one text
            for base in range(0, len(buf) - match + 1, chunk):
                own = buf[base : base + chunk + match - 1]
                yield ids, own, np.array([0, len(own)]), base


def _rows(kind: list[tuple[str, pa.DataType]], rows: list[tuple]):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), kind, strict=True)], [n for n, _ in kind])


def _split(bucket: np.ndarray, n: int):
    """(bucket, index array) of each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    own, new = np.unique(bucket[order], return_index=True)
    return zip(own.tolist(), np.split(order, new[1:]), strict=True) if len(own) else ()


def _home_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Partition of n that a document's reports go to."""
    return (mixed(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


# --- narrowing: which keys (of segments or windows) occur at several places

ASKED = [("bucket", pa.int32()), *((x, pa.binary()) for x in ("key", "doc", "low", "n", "count"))]
ASKED_SQL = "bucket int, key binary, doc binary, low binary, n binary, count binary"


def _asked(buckets: int, held: list[tuple[np.ndarray, ...]]):
    """Rows out of (doc, low, n, key, again) arrays: an entry a key for its home, with its count; the others known to repeat (count 0)."""
    doc, low, n, key, again = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    if not len(doc):  # texts shorter than a match
        return
    order = np.lexsort((low, doc, key))
    doc, low, n, key, again = (x[order] for x in (doc, low, n, key, again))
    same = np.concatenate(([False], key[1:] == key[:-1]))
    again |= np.concatenate(([False], same[1:] & ((doc[1:] != doc[:-1]) | (low[1:] != low[:-1]))))
    group = np.cumsum(~same) - 1
    count = np.where(same, 0, (1 + np.bincount(group, weights=again).astype(np.int64))[group])
    spread = np.where(same, mixed(doc.view(np.uint64) + low.astype(np.uint64)), key)
    yield from _rows(ASKED, [(b, *(packed(x[i]) for x in (key, doc, low.astype(np.int32), n.astype(np.int32), count.astype(np.int32)))) for b, i in _split((spread % np.uint64(buckets)).astype(np.int64), buckets)])


def _ask_segments(buckets: int, match: int, chunk: int):
    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for ids, buf, at, base in _chunks(batches, match, chunk):
            doc, low, n, anchor, again = segments(buf, at, match)
            held.append((ids[doc], low - at[doc] + base, n, anchor, again))
            if sum(len(x[0]) for x in held) >= HELD:
                yield from _asked(buckets, held)
        if held:
            yield from _asked(buckets, held)

    return run


def _ask_windows(buckets: int, match: int):
    """The windows of rows (row, body), by their own hashes; a place is a row and a step from its start."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for row, body in zip(batch.column("row").to_pylist(), byte_rows(batch.column("body")), strict=True):
                h = Spans(np.frombuffer(body, np.uint8)).every(match)
                held.append((np.full(len(h), row, np.int64), np.arange(len(h)), np.ones(len(h), np.int64), h, np.zeros(len(h), bool)))
                if len(held) % 1024 == 0 and sum(len(x[0]) for x in held) >= HELD:
                    yield from _asked(buckets, held)
        if held:
            yield from _asked(buckets, held)

    return run


def _trim(match: int):
    """Rows cut to their runs of windows that are named in places."""

    def run(batches):
        for batch in batches:
            rows = []
            cols = (batch.column(x).to_pylist() for x in ("key", "doc", "low", "places"))
            for body, key, doc, low, places in zip(byte_rows(batch.column("body")), *cols, strict=True):
                own = np.frombuffer(places, PLACE)
                _, first, n = runs_of(np.zeros(len(own), np.int64), own["low"].astype(np.int64), own["n"].astype(np.int64))
                rows += [(key, body[a : a + m + match - 1], doc, low + a, m) for a, m in zip(first.tolist(), n.tolist(), strict=True)]
            yield from _rows(SENT, rows)

    return run


TOLD = [("home", pa.int32()), ("doc", pa.binary()), ("low", pa.binary()), ("n", pa.binary()), ("key", pa.binary()), ("total", pa.int64())]
TOLD_SQL = "home int, doc binary, low binary, n binary, key binary, total long"


def _tell(homes: int, crowd: int):
    """A bucket's entries: those whose key repeats, packed by their document's partition (total: windows).

    Home -1: a key with crowd places or more, total being their number; home -2: total is the number of all entries.
    """

    def run(batches):
        kinds = (np.uint64, np.int64, np.int32, np.int32, np.int32)
        runs = [[unpacked(x, t) for x, t in zip(row, kinds, strict=True)] for batch in batches for row in zip(*(batch.column(x).to_pylist() for x, _ in ASKED[1:]), strict=True)]
        if not runs:
            return
        key, doc, low, n, count = (np.concatenate(x) for x in zip(*runs, strict=True))
        own, back = np.unique(np.where(count > 0, key, np.uint64(0)), return_inverse=True)
        sums = np.bincount(back, weights=count).astype(np.int64)
        repeats = (count == 0) | (sums[back] > 1)
        rows = [(-2, b"", b"", b"", b"", len(key))] + [(-1, b"", b"", b"", own[i].tobytes(), int(sums[i])) for i in np.flatnonzero(sums >= crowd)]
        key, doc, low, n = (x[repeats] for x in (key, doc, low, n))
        for home, i in _split(_home_of(doc, homes), homes):
            i = i[np.lexsort((low[i], doc[i]))]
            rows.append((home, packed(doc[i]), packed(low[i]), packed(n[i]), packed(key[i]), int(n[i].sum())))
        yield from _rows(TOLD, rows)

    return run


def _places_by_doc(batches):
    """(doc, places), a row for each document of the partition that has any."""
    runs = [[unpacked(x, t) for x, t in zip(row, (np.int64, np.int32, np.int32, np.uint64), strict=True)] for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in ("doc", "low", "n", "key")), strict=True)]
    if runs:
        doc, low, n, key = (np.concatenate(x) for x in zip(*runs, strict=True))
        out = np.zeros(len(doc), PLACE)
        out["low"], out["n"], out["key"] = low, n, key
        docs, blob = _blobs(doc, out)
        yield pa.RecordBatch.from_arrays([pa.array(docs), blob], ["doc", "places"])


# --- index families: which windows' bytes start earlier


def runs_of(doc: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, low, n) of the maximal runs of the places low, low + 1, ... low + n - 1."""
    order = np.lexsort((low, doc))
    doc, low, end = doc[order], low[order].astype(np.int64), (low + n)[order].astype(np.int64)
    if not len(doc):
        return doc, low, end
    wide = np.int64(1) << 32
    rank = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1])))
    most = np.maximum.accumulate(rank * wide + end)
    new = np.flatnonzero(np.concatenate(([True], rank[1:] * wide + low[1:] > most[:-1])))
    stop = most[np.append(new[1:], len(doc)) - 1] - rank[new] * wide
    return doc[new], low[new], stop - low[new]


SENT = [("key", pa.int64()), ("body", pa.binary()), ("doc", pa.int64()), ("low", pa.int32()), ("n", pa.int32())]
SENT_SQL = "key long, body binary, doc long, low int, n int"


def _cut(match: int):
    """The bytes of repeating segments, each distinct one once a task; runs known to come later have no body."""

    def run(batches):
        held: dict[bytes, tuple[int, int, int, int]] = {}
        late: list[tuple[int, int, int]] = []
        size = 0

        def flush():
            doc, low, n = runs_of(*(np.array(x, np.int64) for x in (zip(*late, strict=True) if late else ((), (), ()))))
            rows = [(k, body, d, a, m) for body, (d, a, m, k) in held.items()]
            rows += [(int(k), None, *x) for k, *x in zip(mixed(doc.view(np.uint64) + low.view(np.uint64)).view(np.int64).tolist(), doc.tolist(), low.tolist(), n.tolist(), strict=True)]
            held.clear()
            late.clear()
            for at in range(0, len(rows), 8192):
                yield from _rows(SENT, rows[at : at + 8192])

        for batch in batches:
            for text, doc, places in zip(byte_rows(batch.column("text")), batch.column("doc").to_pylist(), batch.column("places").to_pylist(), strict=True):
                own = np.frombuffer(places, PLACE)
                for low, n, key in zip(own["low"].tolist(), own["n"].tolist(), own["key"].view(np.int64).tolist(), strict=True):
                    body = text[low : low + n + match - 1]
                    was = held.get(body)
                    if was is None:
                        held[body] = (doc, low, n, key)
                        size += len(body)
                    elif (doc, low) < was[:2]:
                        held[body] = (doc, low, n, key)
                        late.append(was[:3])
                    elif (doc, low) > was[:2]:
                        late.append((doc, low, n))
                if size > HELD_BYTES or len(late) > HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


class IndexFamily:
    """Suffix arrays, each at least twice as large as the next; add() says which windows repeat an earlier one.

    A window is its bytes (of one length, a numpy string) with its place (doc, low).
    """

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, body: np.ndarray, doc: np.ndarray, low: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(doc, low) arrays of windows now known to start later than an equal one."""
        order = np.argsort(body)  # the batch's suffix array
        batch = [x[order] for x in (body, doc, low)]
        same = np.concatenate(([False], batch[0][1:] == batch[0][:-1]))  # a common prefix of the match length
        first = np.lexsort((batch[2], batch[1], np.cumsum(~same)))
        batch[1], batch[2] = batch[1][first], batch[2][first]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        later = same & ((batch[1] != batch[1][head]) | (batch[2] != batch[2][head]))
        found = [(batch[1][later], batch[2][later])]
        batch = [x[~same] for x in batch]
        for level in self.levels:  # the merge scan
            at = np.searchsorted(level[0], batch[0])
            at[at == len(level[0])] = 0
            equal = level[0][at] == batch[0]
            hit = np.flatnonzero(equal)
            there = at[hit]
            older = (batch[1][hit] < level[1][there]) | ((batch[1][hit] == level[1][there]) & (batch[2][hit] < level[2][there]))
            alike = (batch[1][hit] == level[1][there]) & (batch[2][hit] == level[2][there])
            swap, come = there[older], hit[older]
            found.append((level[1][swap], level[2][swap]))
            level[1][swap], level[2][swap] = batch[1][come], batch[2][come]
            late = hit[~older & ~alike]
            found.append((batch[1][late], batch[2][late]))
            batch = [x[~equal] for x in batch]
        if len(batch[0]):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            two = [np.concatenate(x) for x in zip(self.levels[-2], self.levels[-1], strict=True)]
            order = np.argsort(two[0], kind="stable")  # two sorted runs: merged in one pass
            self.levels[-2:] = [[x[order] for x in two]]
        return found


def windows_of(buf: np.ndarray, start: np.ndarray, match: int) -> np.ndarray:
    """The match bytes from each start, as numpy strings (of one length, so closing zero bytes don't matter)."""
    every = np.lib.stride_tricks.sliding_window_view(buf, match)
    return every[start].view(f"S{match}").ravel()


LATE = [("home", pa.int32()), ("doc", pa.binary()), ("low", pa.binary()), ("n", pa.binary())]
LATE_SQL = "home int, doc binary, low binary, n binary"


def _owner(homes: int, match: int):
    """An owner's segments, batch after batch, through its index family: runs of places that repeat, packed by their document's partition."""

    def run(batches):
        family = IndexFamily()
        found: list[tuple[np.ndarray, ...]] = []

        def out():
            doc, low, n = runs_of(*(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)))
            found.clear()
            yield from _rows(LATE, [(home, packed(doc[i]), packed(low[i].astype(np.int32)), packed(n[i].astype(np.int32))) for home, i in _split(_home_of(doc, homes), homes)])

        for batch in batches:
            doc, low, n = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("doc", "low", "n"))
            known = batch.column("body").is_null().to_numpy(zero_copy_only=False)
            found.append((doc[known], low[known], n[known]))
            part = batch.filter(pa.array(~known))
            doc, low, n = doc[~known], low[~known], n[~known]
            buf, at = utf8(part.column("body"))
            ends = np.cumsum(n)
            edge = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + HELD_WINDOWS, HELD_WINDOWS), "left")
            edge[-1:] = len(ends)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if a == b:
                    continue
                row = np.repeat(np.arange(a, b), n[a:b])
                step = np.arange(len(row)) - np.repeat(ends[a:b] - n[a:b] - (ends[a] - n[a]), n[a:b])
                late = family.add(windows_of(buf, at[row] + step, match), doc[row], (low[row] + step).astype(np.int32))
                found += [(d, p, np.ones(len(d), np.int64)) for d, p in late]
            if sum(len(x[0]) for x in found) > 2 * HELD:
                yield from out()
        if found:
            yield from out()

    return run


def _runs_by_doc(batches):
    """(doc, runs), a row for each document of the partition that has any."""
    runs = [[unpacked(x, t) for x, t in zip(row, (np.int64, np.int32, np.int32), strict=True)] for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in ("doc", "low", "n")), strict=True)]
    if runs:
        doc, low, n = runs_of(*(np.concatenate(x).astype(np.int64) for x in zip(*runs, strict=True)))
        out = np.zeros(len(doc), RUN)
        out["low"], out["n"] = low, n
        docs, blob = _blobs(doc, out)
        yield pa.RecordBatch.from_arrays([pa.array(docs), blob], ["doc", "runs"])


def _remove(match: int):
    def run(batches):
        for batch in batches:
            rows = []
            for text, raw in zip(byte_rows(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
                kept, spans = text, 0
                if raw:
                    own = np.frombuffer(raw, RUN).astype([("low", np.int64), ("n", np.int64)])
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, own["low"], 1)
                    np.add.at(edge, own["low"] + own["n"] - 1 + match, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0]))
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _told(asked: DataFrame, n: int, crowd: int, name: str) -> DataFrame:
    return stored(asked.repartitionById(n, F.col("bucket")).mapInArrow(_tell(n, crowd), TOLD_SQL), name)


def _at_home(told: DataFrame, n: int) -> DataFrame:
    return told.where("home >= 0").select("home", "doc", "low", "n", "key").repartitionById(n, F.col("home")).mapInArrow(_places_by_doc, "doc long, places binary")


def late_runs(rows: DataFrame, by_doc: DataFrame, match: int = 100, chunk: int = CHUNK, crowd: int = CROWD, owned: int = OWNED) -> DataFrame:
    """(home, doc, low, n) packed runs of the places in (doc, text) rows from which match bytes also start earlier; by_doc: rows, dealt by doc."""
    spark = by_doc.sparkSession
    n = partitions(spark)
    told = _told(rows.mapInArrow(_ask_segments(n, match, chunk), ASKED_SQL), n, crowd, "segments")
    sizes = {r.kind: r.total for r in told.groupBy(F.least("home", F.lit(0)).alias("kind")).agg(F.sum("total").alias("total")).collect()}
    hot = max(crowd, sizes.get(-2, 0) // (2 * n))
    keys = [int(np.frombuffer(r.key, np.int64)[0]) for r in told.where("home = -1").where(F.col("total") >= hot).select("key").collect()]  # 2 n rows at most
    sent = by_doc.join(_at_home(told, n), "doc").select("doc", "text", "places").mapInArrow(_cut(match), SENT_SQL)
    if keys:
        sent = stored(sent.withColumn("row", F.monotonically_increasing_id()), "segment-bytes")
        crowded = sent.where(F.col("key").isin(keys) & F.col("body").isNotNull())
        asked = crowded.select("row", "body").mapInArrow(_ask_windows(n, match), ASKED_SQL)
        places = _at_home(_told(asked, n, 2**62, "segment-windows"), n).withColumnRenamed("doc", "row")
        trimmed = crowded.join(places, "row").select("key", "body", "doc", "low", "places").mapInArrow(_trim(match), SENT_SQL)
        sent = sent.where(~F.col("key").isin(keys) | F.col("body").isNull()).drop("row").unionByName(trimmed)
    return sent.repartition(max(n, -(-sizes.get(0, 0) // owned)), "key").mapInArrow(_owner(n, match), LATE_SQL)


def dedup_substrings(docs: DataFrame, match: int = 100, chunk: int = CHUNK, crowd: int = CROWD, owned: int = OWNED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row for each row of docs.

    A byte goes if it lies in match bytes of its text that also start earlier:
    in a text of smaller doc_id, or earlier in its own. Judged on the input. Texts
    are taken in by chunk bytes at a time.

    Null text: empty, nothing to remove. Null doc_id: after all others. Rows that
    repeat a doc_id count in order of a hash of their text; equal ones are judged
    alike, each against what comes before both. Empty table: no rows. Other
    columns are ignored.
    """
    n = partitions(docs.sparkSession)
    rows = texts(docs).withColumn("rid", F.xxhash64("text"))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if repeated:  # ids that follow (doc_id, rid) take their place
        order = stored(rows.select("doc_id", "rid").distinct().orderBy("doc_id", "rid").withColumn("doc", F.monotonically_increasing_id()), "row-order")
        rows = rows.join(order, ["doc_id", "rid"]).select("doc_id", "doc", "text")
    else:
        rows = rows.select(F.col("doc_id"), F.col("doc_id").alias("doc"), "text")
    own = rows.select("doc", "text")
    by_doc = own.repartition(n, "doc")
    late = late_runs(own, by_doc, match, chunk, crowd, owned)
    runs = late.repartitionById(n, F.col("home")).mapInArrow(_runs_by_doc, "doc long, runs binary")
    out = by_doc.join(runs, "doc", "left").select("doc", "text", "runs").mapInArrow(_remove(match), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if repeated:
        out = out.join(order.select("doc", "doc_id"), "doc")
    else:
        out = out.withColumn("doc_id", F.col("doc"))
    return out.select(real_id("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op3(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).drop("kept")
