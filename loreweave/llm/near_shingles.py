"""SimHash near-dedup of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

At that similarity fingerprints of 64 bits differ in about ten, too many for the
segments of ``simhash``. Here they have 256 bits, and 52 may differ. The bits lie
on several rings, each in an order of its own, cut into segments; texts meet where
a whole segment is equal. From there the chain of the next segments must keep to
its share of the 52 differences and three more (two, three and four segments: 9,
12 and 16), and then comes the full Hamming check. Who has a neighbour left in a
meeting place goes there again with its shingles, and the similarity itself decides.

Links are those of a spanning forest of each place, so a group of copies gives as
many links as members. Fingerprints of equal shingle sets are one node. The number
of bits in a segment grows with the logarithm of the nodes, so that places keep to
some hundred of them, and rings are added so that as many pairs meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import byte_rows, partitions, stored, texts
from loreweave.llm.components import components
from loreweave.llm.hashing import mixed
from loreweave.llm.simhash import GIANT

WORDS = 4
BITS = 64 * WORDS
#: Differing bits at most; bits that differ of a pair at the least similarity, as a share.
MOST, SHARE = 52, 0.152
#: Differences that a chain may have above its share: it begins where segments are equal, which is not where the rest is evenest.
SLACK = 3
#: Fingerprints of a meeting place, about; segments that a pair at the least similarity should share.
CROWD, MEETINGS = 256, 3.0


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words: of the whole sequence."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    a, b = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[x:y], 42) for x, y in zip(a, b, strict=True)), np.uint64, len(a)))


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """WORDS words; a bit is set if it is in over half of the hashes."""
    out = np.zeros(WORDS, np.uint64)
    for j in range(WORDS if len(grams) else 0):
        counts = np.zeros(64, np.int64)
        for low in range(0, len(grams), 8192):
            h = mixed(grams[low : low + 8192] * np.uint64(2 * j + 1) + np.uint64(j))
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[j] = np.packbits(2 * counts > len(grams), bitorder="little").view(np.uint64)[0]
    return out


def _prints(shingle: int):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                grams = [shingles(x, shingle) for x in byte_rows(part.column("text"))]
                # Sets are compared by four bytes of each hash.
                small = [np.unique((g >> np.uint64(32)).astype(np.uint32)).tobytes() for g in grams]
                node = np.array([xxhash.xxh3_64_intdigest(g.tobytes()) for g in grams], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(node), pa.array([fingerprint(g).tobytes() for g in grams], pa.binary()), pa.array(small, pa.binary())], ["doc_id", "rid", "node", "print", "grams"])

    return run


def rings(nodes: int) -> tuple[int, int]:
    """(bits of a segment, rings) for so many nodes."""
    width = min(32, max(16, math.ceil(math.log2(max(1, nodes / CROWD)))))
    return width, math.ceil(MEETINGS / (BITS // width * (1 - SHARE) ** width))


def _meet(width: int, n_rings: int):
    """(key, node, print) for each segment of each ring, the print turned so that it begins with that segment."""
    order = [np.random.default_rng(i).permutation(BITS) if i else np.arange(BITS) for i in range(n_rings)]
    turns = BITS // width

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                bits = np.unpackbits(np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")
                for i in range(n_rings):
                    own = bits[:, order[i]]
                    for s in range(turns):
                        turned = np.packbits(np.roll(own, -s * width, axis=1), axis=1, bitorder="little")
                        first = turned[:, :8].copy().view(np.uint64).ravel() & np.uint64((1 << width) - 1)
                        key = first.view(np.int64) + (np.int64(i * turns + s) << np.int64(32))
                        body = pa.py_buffer(np.ascontiguousarray(turned).tobytes())
                        ends = pa.py_buffer((np.arange(len(turned) + 1, dtype=np.int32) * (BITS // 8)).tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array(key), part.column("node"), pa.Array.from_buffers(pa.binary(), len(turned), [None, ends, body])], ["key", "node", "print"])

    return run


def near(one: np.ndarray, many: np.ndarray, width: int) -> np.ndarray:
    """Which prints of many pass the chain that begins at bit 0, and then the full check, against one."""
    head = many[:, 0] ^ one[0]
    ok = np.ones(len(many), bool)
    for l in range(2, 64 // width + 1):
        mask = np.uint64((1 << (l * width)) - 1) if l * width < 64 else np.uint64(2**64 - 1)
        ok &= np.bitwise_count(head & mask) <= l * MOST * width // BITS + SLACK
    at = np.flatnonzero(ok)
    ok[at] = np.bitwise_count(many[at] ^ one).sum(axis=1, dtype=np.int64) <= MOST
    return ok


def _groups(batches, columns: tuple[str, ...]):
    """Lists of rows that share (key, part), out of batches in that order."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in columns), strict=True):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _words(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(-1, WORDS)


def _neighbours(width: int):
    """(key, part, node) of those that have a neighbour in their place."""

    def run(batches):
        out: list[tuple[int, int, int]] = []
        for group in _groups(batches, ("key", "part", "node", "print")):
            if len(group) > 1:
                prints, some = _words([x[3] for x in group]), np.zeros(len(group), bool)
                for i in range(len(group) - 1):
                    ok = near(prints[i], prints[i + 1 :], width)
                    if ok.any():
                        some[i + 1 :] |= ok
                        some[i] = True
                out += [group[i][:3] for i in np.flatnonzero(some).tolist()]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["key", "part", "node"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["key", "part", "node"])

    return run


def similar(one: np.ndarray, many: list[np.ndarray], least: float) -> np.ndarray:
    """Which sorted sets have a Jaccard similarity of least or more with one."""
    size = np.array([len(x) for x in many])
    if not len(one):
        return size == 0
    body = np.concatenate([*many, np.zeros(0, np.uint32)])
    at = np.minimum(np.searchsorted(one, body), len(one) - 1)
    both = np.add.reduceat(np.append(one[at] == body, False), np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)) * (size > 0)
    return both >= least * (size + len(one) - both)


def _links(least: float):
    """(a, b) links of a place that join different groups: similar sets among those whose prints are near."""

    def run(batches):
        for group in _groups(batches, ("key", "part", "node", "print", "grams")):
            nodes, prints = np.array([x[2] for x in group], np.int64), _words([x[3] for x in group])
            sets = [np.frombuffer(x[4], np.uint32) for x in group]
            name, out = np.arange(len(group)), []
            for i in range(len(group) - 1):
                others = i + 1 + np.flatnonzero(name[i + 1 :] != name[i])
                if not len(others):
                    continue
                others = others[np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1, dtype=np.int64) <= MOST]
                if not len(others):
                    continue
                for j in others[similar(sets[i], [sets[j] for j in others.tolist()], least)].tolist():
                    if name[j] != name[i]:
                        out.append((nodes[i], nodes[j]))
                        name[name == name[j]] = name[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def near_shingles(docs: DataFrame, shingle: int = 5, least: float = 0.8, giant: int = GIANT) -> DataFrame:
    """(doc_id, rid, component), a row for each row of docs; component names a group of similar texts.

    Two texts are linked if the Jaccard similarity of their sets of word shingles is
    least or more and their fingerprints differ in 52 of 256 bits at most; groups
    are what links connect.

    Null, empty and white texts: no shingles, all one group. Fewer than shingle
    words: the whole sequence is the one shingle. Null doc_id and repeated rows: a
    row each. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = texts(docs).withColumn("rid", F.xxhash64("text")).mapInArrow(_prints(shingle), "doc_id long, rid long, node long, print binary, grams binary")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "shingle-prints")
    nodes = stored(rows.groupBy("node").agg(F.min("row").alias("row"), F.min("print").alias("print")), "shingle-nodes")
    width, n_rings = rings(nodes.count())
    met = nodes.select("node", "print").mapInArrow(_meet(width, n_rings), "key long, node long, print binary")
    crowded = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > giant).select("key", F.ceil(F.col("n") / giant).alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least(j, own) * F.col("parts") + F.greatest(j, own))
    dealt = met.join(stored(crowded, "shingle-crowds"), "key", "left").select("key", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("part"), "node", "print")
    members = dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_neighbours(width), "key long, part long, node long")
    members = stored(members, "shingle-members").join(nodes.select("node", "row"), "node")
    placed = members.join(rows.select("row", "print", "grams"), "row").select("key", "part", "node", "print", "grams")
    links = placed.repartition(n, "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(_links(least), "a long, b long")
    found = components(links.distinct()).withColumnRenamed("node", "of")
    return rows.join(found, rows.node == found.of, "left").select("doc_id", "rid", F.coalesce("component", "node").alias("component"))
