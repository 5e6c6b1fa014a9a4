"""Exact, line, near and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loreweave.llm import common, components, exact_dedup, line_dedup, simhash, suffix_dedup
from loreweave.llm.queries import ORACLE_SQL, QUERIES
from parity import compare

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(5, None, None, None, None), (6, "", "en", "s", 0), (None, "same text here", "en", "s", 1), (7, "same text here", None, "s", 1), (7, "same text here", None, "s", 1), (8, "same  text here ", "en", None, 1), (9, "é" * 12 + "\nShared line of text\n\n" + "x" * 30_000, "fr", "s", 1), (10, " SHARED line of text \nshared line of text\r\nown", "en", "s", 1)]


def edges(spark):
    """Nulls everywhere, repeated rows, ties, a long text, and columns whose names the operators use themselves."""
    return spark.createDataFrame(EDGES, DOC).withColumns({"rid": F.lit("clash"), "key": F.lit(1), "drop": F.lit(2), "doc": F.lit("x"), "segs": F.lit(0)})


@pytest.mark.parametrize("name", ["op9_line_dedup", "op10_exact_dedup"])
def test_agrees_with_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("operator", [exact_dedup.op10, line_dedup.op9, simhash.op5, suffix_dedup.op3])
def test_edge_rows_and_empty_tables(spark, operator):
    assert operator(edges(spark)).count() == len(EDGES)
    assert operator(edges(spark).limit(0)).count() == 0


def test_exact_dedup_edges(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.op10(edges(spark)).collect()}
    assert {(5, 5, 2, True), (6, 5, 2, False), (8, 8, 4, True), (7, 8, 4, False), (None, 8, 4, False)} <= got


def test_exact_dedup_compares_bytes_of_colliding_keys(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r.keep_id, r.group_size) for r in df.collect())
    assert key(exact_dedup.dedup_exact(docs, hash_bits=3)) == key(exact_dedup.dedup_exact(docs))


def test_directory_splits_overfull_buckets():
    depth, slots, owner = exact_dedup.directory({0: 5, 1: 5, 2: 1, 7: 1}, 3, 6, 2)
    assert depth == 3 and slots.tolist() == [0, 1, 2, 2, 3, 3, 3, 3] and owner.tolist() == [0, 1, 1, 1]
    assert exact_dedup.directory({3: 100}, 2, 6)[0] == 2  # one key can't be split: its chain is long


def test_bucket_files_hold_key_ranges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))
    index = common.stored(docs.repartition(6).select("doc_id", "text").mapInArrow(exact_dedup._entries(64), exact_dedup.ENTRY), "t")
    rows = exact_dedup._hashed_buckets(index, 16, 64).collect()
    assert len(rows) == index.count()
    ranges = {}
    for r in rows:
        ranges.setdefault(r.bucket, []).append(r.key)
    spans = sorted((min(k), max(k), len(set(k))) for k in ranges.values())
    assert len(spans) > 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and max(x[2] for x in spans) <= 16


def test_hot_keys_are_chained_in_parts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    docs = docs.unionByName(docs.limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(10_000), F.lit(10_400)))).repartition(9))
    want = sorted(map(tuple, exact_dedup.op10(docs).collect()))
    monkeypatch.setattr(exact_dedup, "HOT", 3)
    assert sorted(map(tuple, exact_dedup.dedup_exact(docs, hash_bits=4).collect())) == want


def test_line_dedup_edges(spark):
    got = {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.op9(edges(spark)).collect()}
    # The same line in 7 (twice the row), 8 has another key, the null id comes after all.
    assert {(5, 1, 0), (7, 1, 0), (None, 1, 1), (9, 4, 0), (10, 3, 2)} <= got


def test_bloom_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    first, second = (rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    alone, several = np.zeros(3000, np.uint8), np.full(5, line_dedup.SEVERAL, np.uint8)
    one, two, three, four = line_dedup.suspects([(first, alone), (np.concatenate((second, first[:50])), np.zeros(3050, np.uint8)), (first[-5:] + np.uint64(1), several), (first[:3], np.full(3, line_dedup.KNOWN, np.uint8))])
    assert one[:50].all() and two[-50:].all() and three.all() and four.all()
    assert one[50:].mean() < 0.02 and two[:-50].mean() < 0.02


def test_hot_lines_are_joined_in_parts(spark, monkeypatch):
    rows = [(i, f"a line that all hold\nown line number {i}\nline of some {i % 40:04d}") for i in range(400)]
    docs = spark.createDataFrame(rows, DOC.split(", lang")[0]).repartition(8)
    want = sorted((r.doc_id, r.n_dropped, r.kept_sha256) for r in line_dedup.op9(docs).collect())
    assert [x[1] for x in want] == [0] + [1] * 39 + [2] * 360
    monkeypatch.setattr(line_dedup, "HOT", 2)
    assert sorted((r.doc_id, r.n_dropped, r.kept_sha256) for r in line_dedup.op9(docs).collect()) == want


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> i & 1 for x in h) > len(h)) << i for i in range(64)) if h else 0


def brute_components(ids, prints):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4).tolist():
            a, b = sorted((find(i), find(j)), key=lambda x: ids[x])
            root[b] = a
    return {ids[i]: ids[find(i)] for i in range(len(ids))}


def test_near_dedup_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    prints = [brute_print(r.text) for r in rows]
    want = brute_components([r.doc_id for r in rows], prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5(docs).collect()}
    assert got == {r.doc_id: (f"{p:016x}", want[r.doc_id]) for r, p in zip(rows, prints, strict=True)}


def test_hot_fingerprints_meet_their_rows_in_parts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, simhash.op5(docs).collect()))
    monkeypatch.setattr(simhash, "HOT", 1)
    assert sorted(map(tuple, simhash.op5(docs).collect())) == want


def test_rows_without_or_with_one_id_stay_apart(spark, tmp_path):
    """Two null ids and a repeated id, each with two texts; the null ids' texts are near documents 5 and 9."""
    import corpus_pipeline

    rng = random.Random(11)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)) for _ in range(4))
    rows = [(None, a + " end"), (None, b + " end"), (5, a), (9, b), (7, c), (7, d), (None, c[::-1]), (None, d[::-1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)
    got = simhash.near_dedup(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 5), (0, 9), (5, 5), (7, 7), (7, 7), (9, 9)]
    assert len({r.component for r in got}) == 6
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted((i or 0, t) for i, t in rows[2:])


@pytest.mark.parametrize("giant", [40, 20_000])
def test_crowded_fingerprints_keep_their_components(spark, giant):
    """Two dense clouds of fingerprints and scattered ones; a small giant deals keys out as block pairs."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(2)]
    prints = {rng.getrandbits(64) for _ in range(100)} | {c ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for c in centres for _ in range(150)}
    prints = sorted(prints)
    want = brute_components(list(range(len(prints))), prints)
    signed = [(p - 2**64 if p >= 2**63 else p, i) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "fp long, node long")
    links = simhash.near_links(df, giant).join(df.toDF("x", "a"), "x").join(df.toDF("y", "b"), "y").select("a", "b")
    found = {r.node: r.component for r in components.components(links).collect()}
    assert {i: found.get(i, i) for i in range(len(prints))} == want


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 1, n)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(n)} | {n: n, n + 1: n}


def brute_removed(rows, match):
    seen, out = set(), {}
    for doc, text in rows:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - match + 1):
            w = b[i : i + match]
            if w in seen:
                gone[i : i + match] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[doc] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_suffix_dedup_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_removed(sorted((r.doc_id, r.text) for r in docs.collect()), 100)
    assert removed(suffix_dedup.op3(docs.repartition(5))) == want


def test_suffix_dedup_of_repetitive_texts(spark):
    texts = ["a" * 400, "ab" * 300, "abc" * 100 + "x" + "abc" * 100, "q" * 99, "a" * 99, "ab" * 60, "é" * 1000, "".join(random.Random(2).choice("ab") for _ in range(1500)), ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk in (700, suffix_dedup.CHUNK):  # the smaller one takes long texts in pieces
        assert removed(suffix_dedup.dedup_substrings(docs, chunk=chunk)) == brute_removed(rows, 100)


def test_levels_stay_few_when_batches_shrink():
    """Batches of 400, 399, ... 101 windows that none has before: each level is twice the next, whatever comes."""
    family, at = suffix_dedup.IndexFamily(), 0
    for size in range(400, 100, -1):
        body = np.array([f"{i:0100d}" for i in range(at, at + size)], "S100")
        assert not sum(len(d) for d, _ in family.add(body, np.arange(at, at + size), np.zeros(size, np.int64)))
        at += size
        sizes = [len(x[0]) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= np.log2(at) + 1
    assert sum(sizes) == at


def test_repeated_ids_of_different_texts_count_in_order_of_their_hash(spark):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=150))
    rows = [(1, f"{rng.random()} {passage} x{i}") for i in range(4)] + [(2, passage), (2, passage), (None, f"y {passage}"), (None, f"z {passage} z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    place = {(r.doc_id, r.text): (r.doc_id if r.doc_id is not None else 2**63 - 1, r.rid) for r in df.withColumn("rid", F.xxhash64("text")).collect()}
    seen, removed = set(), {}
    for key in sorted(place, key=lambda k: place[k]):
        raw = key[1].encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
        seen |= {raw[i : i + 100] for i in range(len(raw) - 99)}
        removed[key] = int(gone.sum())
    want = sorted(((-1 if i is None else i), len(t.encode()), removed[i, t]) for i, t in rows)
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.n_bytes, r.n_removed) for r in suffix_dedup.op3(df).collect()) == want


def test_index_family_levels_fall_geometrically():
    rng = np.random.default_rng(1)
    family, seen, late, want = suffix_dedup.IndexFamily(), {}, set(), set()
    for batch in range(20):
        body = np.array([b"%04d" % x for x in rng.integers(0, 400, 30)], "S4")
        doc = rng.integers(0, 50, 30)
        low = np.arange(30, dtype=np.int64) + 100 * batch
        for x, d, p in zip(body.tolist(), doc.tolist(), low.tolist(), strict=True):
            seen.setdefault(x, []).append((d, p))
        for d, p in family.add(body, doc, low):
            late |= set(zip(d.tolist(), p.tolist(), strict=True))
    for places in seen.values():
        want |= set(sorted(places)[1:])
    assert late == want
    sizes = [len(x[0]) for x in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
    assert all((x[0][1:] > x[0][:-1]).all() for x in family.levels)  # suffix arrays: in order of bytes


def test_windows_that_end_in_zero_bytes():
    buf = np.frombuffer(b"ab\0\0ab\0\0ab\0x", np.uint8)
    got = suffix_dedup.windows_of(buf, np.array([0, 4, 8, 1]), 4)
    assert got[0] == got[1] != got[2] and got[3] != got[0]


def test_runs_merge_where_they_touch():
    doc, low, n = suffix_dedup.runs_of(*(np.array(x) for x in ([2, 1, 1, 1, 1], [0, 5, 0, 9, 3], [4, 4, 3, 1, 1])))
    assert list(zip(doc.tolist(), low.tolist(), n.tolist(), strict=True)) == [(1, 0, 4), (1, 5, 5), (2, 0, 4)]


@pytest.mark.parametrize(("parts", "crowd", "owned"), [(32, 3, 1 << 21), (4, 4096, 500)])
def test_suffix_dedup_of_crowded_anchors(spark, monkeypatch, parts, crowd, owned):
    """A passage that every text holds amid words of its own; few segments make an anchor crowded, or owners get few windows."""
    asked, was = [], suffix_dedup._ask_windows
    monkeypatch.setattr(suffix_dedup, "_ask_windows", lambda *x: asked.append(x) or was(*x))
    monkeypatch.setattr(suffix_dedup, "partitions", lambda spark: parts)
    rng = random.Random(6)
    say = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    hot, warm = say(260), say(180)
    rows = [(i, say(150) + (hot if i % 3 else warm) + say(120) + (warm if i % 7 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert removed(suffix_dedup.dedup_substrings(docs, crowd=crowd, owned=owned)) == brute_removed(rows, 100)
    assert bool(asked) == (parts == 32)


@pytest.mark.parametrize("parts", [4, 48])
def test_reports_do_not_grow_with_partitions_times_documents(spark, sf, parts):
    """Rows that tasks hand on: packed by destination (partitions squared at most), or one for each segment sent, at any number of partitions."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS doc", "text")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        late = common.stored(suffix_dedup.late_runs(docs, docs.repartition(parts, "doc")), "t")
        assert late.count() <= parts * parts
        packed_places = sum(len(r.doc) // 8 for r in late.collect())
        by_doc = late.repartitionById(parts, F.col("home")).mapInArrow(suffix_dedup._runs_by_doc, "doc long, runs binary")
        n = by_doc.count()
        assert n == by_doc.select("doc").distinct().count() <= docs.count() and packed_places < 40 * n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_packing():
    x = np.array([1, 2**40, -5])
    assert common.unpacked(common.packed(x), np.int64).tolist() == x.tolist()
