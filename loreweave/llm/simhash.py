"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into 5 segments on a ring. If two differ in at
most t = 4 bits, some segment starts a chain in which every l consecutive
segments differ in at most floor(l * t / 5) bits: 0, 1, 2, 3, 4. So a candidate
pair agrees in a whole segment and, its successor differing in one bit at most,
in one half of the successor: those 19 or 20 bits are the key under which
fingerprints meet. Inside a key the rest of the chain's budgets prunes pairs
before the Hamming distance is taken.

Fingerprints are made distinct first, so exact copies never meet as pairs. In a
crowded key only links that join two groups are kept (a spanning forest), which
loses no component and never emits all pairs of a group. A key with more than
``GIANT`` fingerprints is dealt out as block pairs over several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import byte_rows, partitions, real_id, stored, texts
from loreweave.llm.components import components

#: Low bit and width of each segment.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
SMALL, GIANT = 16, 20_000
#: Fingerprints with over this share of all rows, and so many, meet their rows in SALTS parts.
HOT_SHARE, HOT, SALTS = 0.001, 4096, 32


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """A bit is set if it is in over half of the XXH64 of all shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for low in range(0, n, 4096):
        h = np.array([digest(joined[x:y], seed) for x, y in zip(a[low : low + 4096], b[low : low + 4096], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _prints(shingle: int):
    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x, shingle) for x in byte_rows(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(fp.view(np.int64))], ["doc_id", "rid", "fp"])

    return run


def ring_keys(fp):
    """(key) array of the ten places where a fingerprint column may meet a neighbour."""
    out = []
    for i, (low, width) in enumerate(SEGMENTS):
        then, size = SEGMENTS[(i + 1) % 5]
        first = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        half = size // 2
        for h, (at, bits) in enumerate(((then, half), (then + half, size - half))):
            part = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))
            out.append(F.shiftleft(first, 8).bitwiseOR(part).bitwiseOR(F.lit((2 * i + h) << 24)).cast("long"))
    return F.array(*out)


def linked(x: np.ndarray, y: np.ndarray, start: np.ndarray | int, most: int = 4) -> np.ndarray:
    """Which pairs pass the budgets of the chain that begins at segment start, and then the full check."""
    delta = x ^ y
    by = np.stack([np.bitwise_count((delta >> np.uint64(low)) & np.uint64((1 << width) - 1)) for low, width in SEGMENTS], axis=-1).astype(np.int64)
    chain = np.take_along_axis(by, (np.broadcast_to(start, x.shape)[:, None] + np.arange(5)) % 5, axis=-1)
    total = np.cumsum(chain, axis=-1)
    return (total * 5 <= np.arange(1, 6) * most).all(axis=-1)


def chained(fps: np.ndarray, fp: np.uint64, start: int, most: int = 4) -> np.ndarray:
    """Places in fps of those that keep each budget of the chain from segment start to fp, the whole ring last."""
    at, total = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for l in range(1, 6):
        low, width = SEGMENTS[(start + l - 1) % 5]
        total = total + np.bitwise_count(((fps[at] ^ fp) >> np.uint64(low)) & np.uint64((1 << width) - 1))
        fine = total * 5 <= l * most
        at, total = at[fine], total[fine]
    return at


def _forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links of one key that join different groups."""
    group, out = np.arange(len(fps)), []
    for i in range(len(fps) - 1):
        others = np.flatnonzero(group != group[i])
        if not len(others):
            break
        others = others[others > i]
        near = others[chained(fps[others], fps[i], start)]
        for j in near.tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def _links(batches):
    held_key, held = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)

    def groups(key, part, fp):
        edges_a, edges_b = [], []
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        sizes = np.diff(np.append(new, len(key)))
        group = np.repeat(np.arange(len(new)), sizes)
        small = sizes[group] <= SMALL
        at = np.flatnonzero(small)
        k, f, g = key[at], fp[at], group[at]
        for d in range(1, min(SMALL, len(at))):
            same = np.flatnonzero(g[d:] == g[:-d])
            if not len(same):
                break
            ok = linked(f[same], f[same + d], (k[same] >> 25).astype(np.int64))
            edges_a.append(f[same][ok])
            edges_b.append(f[same + d][ok])
        for i in np.flatnonzero(sizes > SMALL).tolist():
            own = fp[new[i] : new[i] + sizes[i]]
            pairs = np.array(_forest(own, int(key[new[i]] >> 25)), np.int64).reshape(-1, 2)
            edges_a.append(own[pairs[:, 0]])
            edges_b.append(own[pairs[:, 1]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (edges_a, edges_b))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["x", "y"])

    for batch in batches:
        key, part, fp = (np.concatenate((h, batch.column(i).to_numpy(zero_copy_only=False))) for i, h in enumerate((held_key, held[0], held[1])))
        if not len(key):
            continue
        last = np.flatnonzero((key != key[-1]) | (part != part[-1]))
        cut = last[-1] + 1 if len(last) else 0  # the last group may go on
        if cut:
            yield groups(key[:cut], part[:cut], fp[:cut].view(np.uint64))
        held_key, held = key[cut:], np.stack((part[cut:], fp[cut:]))
    if len(held_key):
        yield groups(held_key, held[0], held[1].copy().view(np.uint64))


def near_links(prints: DataFrame, giant: int = GIANT) -> DataFrame:
    """(x, y) links between distinct fingerprints (fp) at 4 or fewer bits, enough of them to connect each component."""
    spark = prints.sparkSession
    keys = stored(prints.select("fp").distinct().select(F.explode(ring_keys(F.col("fp"))).alias("key"), "fp"), "ring-keys")
    crowded = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > giant).select("key", F.ceil(F.col("n") / giant).alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least(j, own) * F.col("parts") + F.greatest(j, own))
    dealt = keys.join(crowded, "key", "left").select("key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("part"), "fp")
    return dealt.repartition(partitions(spark), "key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_links, "x long, y long").distinct()


def near_dedup(docs: DataFrame, shingle: int = 4, giant: int = GIANT) -> DataFrame:
    """(doc_id, rid, fingerprint, component_id, component), a row for each row of docs.

    component names a group of linked rows, whatever their ids (its smallest
    fingerprint); component_id is the smallest doc_id in it, null if it has none.

    Null, empty and white texts: fingerprint 0, linked like any other. Fewer than
    shingle words: the whole sequence is the one shingle. Null doc_id: after all
    others. Repeated rows: a row each. Empty table: no rows. Other columns are
    ignored.
    """
    rows = stored(texts(docs).withColumn("rid", F.xxhash64("text")).mapInArrow(_prints(shingle), "doc_id long, rid long, fp long"), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = [r.fp for r in nodes.where(F.col("n") > max(HOT, int(total * HOT_SHARE))).select("fp").collect()]  # under 1 / HOT_SHARE rows
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    found = components(near_links(nodes, giant).toDF("a", "b")).withColumnRenamed("node", "fp")
    named = stored(nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = named.join(least, "component").select("fp", "component", "component_id", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    dealt = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id", "rid"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    out = dealt.join(told, ["fp", "salt"])
    return out.select(real_id("doc_id"), "rid", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real_id("component_id"), "component")


def op5(docs: DataFrame) -> DataFrame:
    return near_dedup(docs).drop("rid", "component")
