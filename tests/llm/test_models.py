"""Licence scan, codec, language model, top-k, mixing and quality."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loreweave.llm import license_scan, lm, mixing, quality, sentencepiece_codec, simhash, suffix_dedup, topk
from loreweave.llm.queries import ORACLE_SQL, QUERIES
from parity import compare
from test_dedup import EDGES, edges


@pytest.mark.parametrize("name", ["op1_license_scan", "op6_top_k", "op7_mix"])
def test_agrees_with_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("operator", [license_scan.op1, sentencepiece_codec.op2, lm.op4, mixing.op7, quality.op8])
def test_edge_rows_and_empty_tables(spark, operator):
    assert operator(edges(spark)).count() == len(EDGES)
    assert operator(edges(spark).limit(0)).count() == 0


def test_values_on_null_and_empty_texts(spark):
    """What each operator says of documents 5 (null) and 6 (empty), and of the rows that repeat 7."""
    of = lambda operator: {r.doc_id: r for r in operator(edges(spark)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    one, two, three, four, five, seven, eight = map(of, (license_scan.op1, sentencepiece_codec.op2, suffix_dedup.op3, lm.op4, simhash.op5, mixing.op7, quality.op8))
    for d in (5, 6):
        assert (one[d].license, one[d].n_licenses) == (None, 0) and (two[d].ids, two[d].n_pieces, two[d].round_trip) == ([], 0, True)
        assert (three[d].n_bytes, three[d].n_removed, three[d].n_spans, three[d].kept_sha256) == (0, 0, 0, empty)
        assert four[d].n_tokens == 1 and math.isfinite(four[d].score) and (five[d].fingerprint, five[d].component_id) == ("0" * 16, 5)
        assert (seven[d].size, seven[d].taken, seven[d].first_slot) == (0, 0, None) and eight[d].keep
    assert five[7].fingerprint == five[None].fingerprint and five[None].component_id == 7
    assert two[7].ids == two[None].ids and eight[7].p_bad == eight[None].p_bad and four[7].score == four[None].score
    taken = sorted(r.taken for r in mixing.op7(edges(spark)).where("doc_id = 7").collect())
    assert taken[1] <= 6 and mixing.op7(edges(spark)).where("taken > 2 * size").count() == 0
    assert topk.op6(spark.createDataFrame([(None, [1.0]), (0, None), (0, []), (50, [])], "vec_id long, embedding array<double>")).count() == 2


# --- licence scan


def test_size_bounds_lose_no_match():
    known = license_scan.Templates(license_scan.TEMPLATES, 0.8)
    hits = 0
    for text in (x for own in license_scan.TEMPLATES.values() for x in own):
        words = license_scan.WORD.findall(text.lower().encode())
        for n in {len(words), max(2, len(words) * 9 // 10), max(2, len(words) * 3 // 4), max(2, len(words) // 2)}:
            grams = frozenset(zip(words[: n - 1], words[1:n], strict=True))
            brute = sorted((name, license_scan.dice(grams, own)) for name, _, own in known.items if license_scan.dice(grams, own) >= 0.8)
            assert sorted(known.matches(grams)) == brute
            hits += len(brute)
    assert hits > 60


def test_licence_over_broken_lines(spark):
    mit = license_scan.TEMPLATES["MIT"][2].replace(" deal in", "\ndeal in").replace(" THE SOFTWARE IS", "\nTHE SOFTWARE IS")
    docs = spark.createDataFrame([(1, "x y\n" + mit + "\nend"), (2, "nothing here")], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.lines) for r in license_scan.scan(docs, spans=(2, 3)).collect()}
    assert got == {1: ("MIT", 3), 2: (None, None)}


def test_licence_wrapped_and_embedded(spark):
    """Whatever surrounds a notice and wherever its lines break; brute force over all windows of words."""
    wrap = lambda x, n: "\n".join(" * " + " ".join(x.split()[i : i + n]) for i in range(0, len(x.split()), n))
    body = "".join(f"some code that says nothing of terms {i}\n" for i in range(60))
    own = license_scan.TEMPLATES
    rows = [
        "/*\n" + wrap(own["Apache-2.0"][1], 9) + "\n */\n" + body,
        body + wrap(own["GPL-3.0"][1], 7) + "\n" + body,
        body + own["MIT"][2].replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS") + "\n" + body,
        "a long line of other words before it " * 9 + own["MIT"][1] + " and after it" * 9,
        body + wrap(own["MIT"][1], 2) + "\n" + body + wrap(own["GPL-3.0"][1], 11),
        "all rights " * 400,
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [got[i].license for i in range(6)] == ["Apache-2.0", "GPL-3.0", "MIT", "MIT", "GPL-3.0", None]
    assert [len(got[i].found) for i in range(6)] == [1, 1, 1, 1, 2, 0] and all(got[i].dice == 1 for i in range(5))
    assert (got[1].first_line, got[1].lines) == (60, len(wrap(own["GPL-3.0"][1], 7).split("\n")))
    known = license_scan.Templates(own, 0.8)
    for text in rows[3], "x all rights\nreserved under the MIT\nlicense licensed under the MIT License the MIT License version 2":
        words = license_scan.WORD.findall(text.encode().lower())
        pairs = list(zip(words[:-1], words[1:], strict=True))
        brute = {}
        for i in range(len(pairs)):
            for j in range(i, min(len(pairs), i + 60)):
                for name, d in known.matches(frozenset(pairs[i : j + 1])):
                    brute[name] = max(d, brute.get(name, 0))
        best = {}
        for name, d, *_ in known.windows(pairs):
            best[name] = max(d, best.get(name, 0))
        assert best == brute and brute


def test_whole_licences_are_told_apart(spark):
    """Each template amid code, wrapped; the longest of its family wins."""
    own = license_scan.TEMPLATES
    body = "".join(f"int value_{i} = compute(value_{i}, {i});\n" for i in range(40))
    names = ["BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "LGPL-2.1", "AGPL-3.0", "GPL-2.0", "BSL-1.0"]
    rows = [(i, body + "\n".join(" * " + " ".join(own[n][-1].split()[k : k + 10]) for k in range(0, len(own[n][-1].split()), 10)) + "\n" + body) for i, n in enumerate(names)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(len(names))] == names and all(r.dice > 0.99 and r.first_line == 40 for r in got.values())


def test_licence_scan_of_ties_and_long_texts(spark):
    """Equal scores: the licence of smaller name, then the earlier line; a long text without licences costs no more than reading it."""
    rows = [(1, "Licensed under the MIT License.\nx\nAll rights reserved."), (2, "All rights reserved.\nAll rights reserved."), (3, "word " * 400_000), (4, None)]
    got = {r.doc_id: (r.license, r.first_line, len(r.found)) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("All-Rights-Reserved", 2, 2), 2: ("All-Rights-Reserved", 0, 1), 3: (None, None, 0), 4: (None, None, 0)}


# --- SentencePiece


ODD = ["", "  ", " a", "a\n\n b  c   ", "x" * 300, "héllo ﬁ ™ 漢字テスト 안녕 " * 5, "\t\t if (x): return  <s> </s> <0x41>", "ab" * 200 + "漢" * 70, "https://example.com/a?b=c#e", "\x00\x01", "\U0001f600\U0001f600 emoji"]


def test_codec_equals_the_library(spark, sf):
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rows = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.Model())
    ids, at = encoder.encode([x.encode() for x in rows])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(rows)
    assert [x.decode() for x in sentencepiece_codec.decode_rows(encoder.m, ids, at)] == rows


def test_codec_takes_long_units_in_bounded_time():
    """Runs without a place to cut, as the library has them; 100,000 characters in seconds."""
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    encoder = sentencepiece_codec.Encoder(sentencepiece_codec.Model())
    rng = random.Random(1)
    rows = ["a" * 100_000, "".join(rng.choices("etaoinsr", k=100_000)), "ab" * 99 + "x", "x" * 193, "e" * 70_000 + "\U0001f600" + "the" * 500]
    began = time.time()
    ids, at = encoder.encode([x.encode() for x in rows])
    assert time.time() - began < 30
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == library.encode(rows)


def test_long_units_of_a_unigram_model_take_the_best_sum(monkeypatch):
    m = sentencepiece_codec.Model()
    m.bpe = False
    m.scores = np.random.default_rng(4).normal(-5, 2, m.size)
    encoder = sentencepiece_codec.Encoder(m)
    monkeypatch.setattr(sentencepiece_codec, "STRETCH", 16)
    chars = np.array([ord(c) for c in "▁unbelievabletionentertainmentheader" * 3], np.uint32)
    assert encoder.alone(chars)[0].tolist() == encoder.viterbi(chars[None])[0].tolist()


def test_codec_round_trip_on_spark(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    out = sentencepiece_codec.encode(docs)
    assert out.where("round_trip").count() == len(ODD)
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(out).collect()} == dict(enumerate(ODD))


def test_unigram_takes_the_best_sum():
    """A model of our own numbers: the maximum over all segmentations."""
    m = sentencepiece_codec.Model()
    m.bpe = False
    m.scores = np.random.default_rng(4).normal(-5, 2, m.size)
    encoder = sentencepiece_codec.Encoder(m)
    names = {"".join(map(chr, m.chars[i].tolist())): i for i in m.ids.tolist()}

    def best(word):
        top = [(0.0, [])] + [None] * len(word)
        for j in range(1, len(word) + 1):
            options = [(top[i][0] + m.scores[names[word[i:j]]], [*top[i][1], names[word[i:j]]]) for i in range(max(0, j - 16), j) if word[i:j] in names]
            top[j] = max(options)
        return top[-1][1]

    for word in ["▁entertainment", "▁the", "▁unbelievable", "▁tionheader"]:
        chars = np.array([[ord(c) for c in word]], np.uint32)
        assert encoder.viterbi(chars)[0].tolist() == best(word)


# --- language model


def test_base_score_and_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tokens, count = {}, Counter()
    for r in docs.collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), r.text.encode()))
        tokens[r.doc_id] = [*words, None]
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            count.update(tokens[r.doc_id])
    n, v = sum(count.values()), len(count)
    got = lm.op4(docs).collect()
    for r in got:
        own = tokens[r.doc_id]
        want = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(own), sum(count[t] > 0 for t in own), n)
        assert r.base_score == pytest.approx(want, rel=1e-9)
    seen = [r for r in got if r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_score_against_a_plain_sum(spark, sf, monkeypatch):
    """Every text's score from the trained parameters, token by token; over all words and one unknown, p sums to 1."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(lm, "top_words", lambda tokens: 200)
    seen, was = [], lm._score
    monkeypatch.setattr(lm, "_score", lambda shared, owners: seen.append(shared.value) or was(shared, owners))
    got = {r.doc_id: r.score for r in lm.op4(docs).collect()}
    p, stats, top, shape_n, shape_v = seen[0]
    tokens, count = {}, Counter()
    for r in docs.collect():
        tokens[r.doc_id] = re.findall(rb"[^\x20\x09-\x0D]+", r.text.encode().lower())
        if zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            count.update(tokens[r.doc_id])
    words = {w for x in tokens.values() for w in x}
    place = {int(h): 1 + i for i, h in enumerate(top.tolist())}
    kind = {}
    for w in words:
        buf = np.frombuffer(w, np.uint8)
        shape = int(lm.shapes(buf, np.array([0]), np.array([len(w)]))[0])
        kind[w] = (place.get(int(lm.Spans(buf).of(np.array([0]), np.array([len(w)]))[0])), shape)
    assert sum(c is not None for c, _ in kind.values()) == 200 == len(top) and len(p["bias"]) == 321
    one, two = p["words"] @ p["first"].T, p["words"] @ p["second"].T

    def distribution(a, b):
        s = ((one[b] + two[a]) @ p["out"].T + p["bias"]).astype(float)
        e = np.exp(s - s.max())
        return e / e.sum()

    def within(w):
        top_class, shape = kind[w]
        return 1.0 if top_class else (count[w] + 0.5) / (shape_n[shape] + 0.5 * (shape_v[shape] + 1))

    for d in sorted(got)[::9]:
        before, total = [0, 0], 0.0
        for w in [*tokens[d], None]:
            c = 0 if w is None else kind[w][0] or 201 + kind[w][1]
            total += math.log10(distribution(*before)[c]) + (0.0 if w is None else math.log10(within(w)))
            before = [before[1], c]
        assert got[d] == pytest.approx(total, rel=1e-4)
    dist = distribution(5, 201)
    known = [w for w in words if count[w]]
    mass = dist[0] + sum(dist[kind[w][0] or 201 + kind[w][1]] * within(w) for w in known) + sum(dist[201 + s] * 0.5 / (shape_n[s] + 0.5 * (shape_v[s] + 1)) for s in range(lm.SHAPES))
    assert mass == pytest.approx(1.0, rel=1e-5)


def test_class_probabilities_are_normalised():
    p = lm.fresh(np.full(lm.CLASSES, 1 / lm.CLASSES))
    context = np.array([0, 5, 70_00, 65_535])
    total = sum(10 ** lm.log10_probabilities(p, context, np.full(4, c)) for c in range(lm.CLASSES))
    assert total == pytest.approx(np.ones(4))


def test_nce_learns_a_context():
    """Class 1 follows class 2, class 3 follows class 4: the right one gets likelier."""
    unigram = np.full(lm.CLASSES, 1 / lm.CLASSES)
    code = np.array([2 * lm.CLASSES + 1, 4 * lm.CLASSES + 3], np.uint32)
    p = lm.fresh(unigram)
    for seed in range(200):
        p = lm.nce_epoch(p, code, np.array([50, 50]), unigram, seed)
    right, wrong = (lm.log10_probabilities(p, np.array([2, 4]), np.array(c)) for c in ([1, 3], [3, 1]))
    assert (right > wrong + 0.5).all()


# --- top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-3, 4, (700, 6)) / 4  # many ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 6), (None, [1.0] * 6), (1150, [float("inf")] * 6), (1200, [0.5] * 3), (1201, [0.25] * 3), (1250, [])]
    got = {}
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("width", F.lit("clash"))
    for r in topk.op6(df.repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(256 * x).astype(int)
    for i in range(0, 700, 50):
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-int(q[i] @ q[j]), j))[:5]
        assert sorted(got.pop(i)) == [(n + 1, j, int(q[i] @ q[j])) for n, j in enumerate(order)]
    assert got == {1200: [(1, 1201, 3 * 128 * 64)]}
    assert topk.op6(df.limit(0)).count() == 0


@pytest.mark.parametrize("column", [1, 64])
def test_top_k_takes_repeated_ids_and_large_components(spark, monkeypatch, column):
    """Every row is a candidate, whatever its id; sums beyond doubles' and longs' exact ranges keep their order."""
    rng = random.Random(8)
    rows = [(i, [float(rng.randint(-9, 9)) * 10.0 ** rng.choice((0, 0, 7, 12, 30)) for _ in range(3)]) for i in range(120)]
    rows += [(50, [1.0, 2.0, 3.0]), (50, [1.0, 2.0, 3.0]), (7, [5.0, 5.0, 5.0]), (7, [5.0, 5.0, 5.0]), (100, [1e300] * 3), (101, [-1e300] * 3), (102, [1e307] * 3)]
    monkeypatch.setattr(topk, "COLUMN", column)
    monkeypatch.setattr(topk, "QUERIES", 2)
    monkeypatch.setattr(topk, "BLOCK", 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if math.isfinite(256 * v[0])]
    want = Counter()
    for q, (i, v) in enumerate(whole):
        if i % 50 == 0:
            order = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for c, (j, w) in enumerate(whole) if c != q)[:5]
            want.update((i, n + 1, j, max(-topk.LONG, min(topk.LONG, -s))) for n, (s, j) in enumerate(order))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op6(df).collect()) == want


# --- mixing


def test_schedule_interleaves_and_meets_quotas(spark):
    q = spark.createDataFrame([(0, 1000, 2000), (1, 5000, 3000), (2, 10, 15), (3, 7, 0)], "sid long, source_size long, quota long")
    plan = mixing.schedule(q, 64).orderBy("slot").collect()
    taken = Counter()
    for r in plan:
        taken[r.sid] += r.take
    assert taken == {0: 2000, 1: 3000, 2: 15}
    firsts = [r.sid for r in plan[:20]]
    assert 6 <= firsts.count(0) <= 11  # even a short run has a source's share


def test_slots_are_the_schedule_of_a_plain_loop(spark, monkeypatch):
    """Documents come in the slots that a loop over the golden-ratio points gives them; other points give other slots."""
    rng = random.Random(4)
    docs = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice((0, 3, 40, 300)))), rng.choice(("a", "b", "c", None))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    got = {r.doc_id: r for r in mixing.mix(df, block_tokens=64).collect()}

    def plain(golden):
        sources = sorted({x for *_, x in docs}, key=lambda x: (x is None, x))
        size = {s: sum(len(t.split()) for _, t, x in docs if x == s) for s in sources}
        quota = {s: round(next(r.target for i, r in got.items() if docs[i][2] == s)) for s in sources}
        blocks = {s: -(-size[s] // 64) for s in sources}
        slots = {s: quota[s] // size[s] * blocks[s] + -(-(quota[s] % size[s]) // 64) for s in sources}
        n, rank, order = sum(slots.values()), Counter(), []
        bounds = np.cumsum([slots[s] for s in sources])
        for i in range(n):
            s = sources[int(np.searchsorted(bounds, math.floor((i + 1) * golden % 1.0 * n), "right"))]
            order.append((i, s, rank[s]))
            rank[s] += 1
        order += [(n + k, s, k) for s in sources for k in range(rank[s], slots[s])]
        out = {}
        for slot, s, k in order:
            if k >= slots[s]:
                continue
            epoch, block = divmod(k, blocks[s])
            low = block * 64
            high = min(low + 64, size[s], quota[s] - epoch * size[s])
            for i, r in got.items():
                if docs[i][2] == s and r.size and max(low, r.start) < min(high, r.start + r.size):
                    was = out.get(i, (slot, slot, 0))
                    out[i] = (min(was[0], slot), max(was[1], slot), was[2] + min(high, r.start + r.size) - max(low, r.start))
        return {i: out.get(i, (None, None, 0)) for i in got}

    assert {i: (r.first_slot, r.last_slot, r.taken) for i, r in got.items()} == plain(mixing.GOLDEN)
    monkeypatch.setattr(mixing, "GOLDEN", 0.123)
    other = {r.doc_id: (r.first_slot, r.last_slot, r.taken) for r in mixing.mix(df, block_tokens=64).collect()}
    assert other == plain(0.123) != {i: (r.first_slot, r.last_slot, r.taken) for i, r in got.items()}


def test_targets_are_capped_and_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0 and got["b"] == pytest.approx((2010 * 1.5 - 20) / 3) and got["c"] == pytest.approx((2010 * 1.5 - 20) * 2 / 3)


# --- quality


def test_classifier_agrees_with_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = quality.op8(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert sum(r.keep for r in good) / len(good) > 0.98 and sum(not r.keep for r in bad) / len(bad) > 0.9


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.3
    rates = np.array([0.95, 0.9, 0.8, 0.7, 0.9, 0.85, 0.6, 0.75])
    votes = np.where(rng.random((len(truth), 8)) < rates, truth[:, None], ~truth[:, None]).astype(int)  # 0 good, 1 bad
    patterns, counts = np.unique(votes @ 3 ** np.arange(8), return_counts=True)
    post, table = quality.accuracies(patterns, counts)
    assert np.abs(table[:, 1, 1] - rates).max() < 0.05 and np.abs(table[:, 0, 0] - rates).max() < 0.05


def test_em_against_plain_loops():
    """Posteriors of a few vote patterns, round by round, without arrays."""
    rng = random.Random(5)
    rows = [[rng.choice((0, 0, 1, 2)) for _ in quality.LABELLERS] for _ in range(40)]
    times = [rng.randint(1, 30) for _ in rows]
    post = []
    for v in rows:
        bad, good = v.count(1), v.count(0)
        start = (bad + 0.5) / (bad + good + 1) if bad + good else 0.5
        post.append(max(start, 0.9) if bad else min(start, 0.1 if good else 0.5))
    for _ in range(7):
        table = [[[1e-2 + sum((p if c else 1 - p) * n for v, p, n in zip(rows, post, times, strict=True) if v[i] == x) for x in range(3)] for c in range(2)] for i in range(len(rows[0]))]
        total = [sum((p if c else 1 - p) * n for p, n in zip(post, times, strict=True)) for c in range(2)]
        after = []
        for v in rows:
            like = [math.log((total[c] + 1) / (sum(total) + 2)) + sum(math.log(table[i][c][x] / sum(table[i][c])) for i, x in enumerate(v)) for c in range(2)]
            after.append(1 / (1 + math.exp(max(-50, min(50, like[0] - like[1])))))
        post = after
    codes = np.array([sum(x * 3**i for i, x in enumerate(v)) for v in rows])
    assert quality.accuracies(codes, np.array(times, float), 7)[0] == pytest.approx(post)


def test_scores_against_plain_loops(spark, sf):
    """p_bad of every document from the learned weights, features counted one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    w, bias, prior = quality.learned(docs)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    got = {r.doc_id: r.p_bad for r in quality.op8(docs).collect()}
    for d in sorted(texts)[::7]:
        raw = texts[d] + b" "
        words = raw.split()
        size = max(1, len(words))
        low = [x.lower() for x in words]
        black = sum(map(len, words))
        letters = sum(chr(b).isascii() and chr(b).isalpha() for b in raw)
        kind = lambda b: int(quality._KIND[b])
        m = [
            sum(kind(b) == 4 for b in raw) / max(1, black), sum(65 <= b <= 90 for b in raw) / max(1, letters), sum(a == b for a, b in zip(low, low[1:], strict=False)) / size, len(set(low)) / size,
            sum(len(x) == 1 and kind(x[0]) == 4 for x in words) / size, sum(len(x) > 2 and kind(x[-1]) >= 3 and kind(x[-2]) >= 3 for x in words) / size, sum(len(x) <= 3 and kind(x[0]) == 1 for x in words) / size,
            sum(len(x) for x in words if len(x) > 64 and x[0] < 128) / max(1, black),
        ]
        grams = Counter(((a * 40503 + b * 9973 + c * 613) ^ (a << 3)) % quality.WIDTH for a, b, c in zip(raw, raw[1:], raw[2:], strict=False))
        x = {k: math.sqrt(v / sum(grams.values())) for k, v in grams.items()}
        for i, y in enumerate(m):
            k = (math.floor(8 * math.sqrt(y)) * 7919 + i * 104729) % quality.WIDTH
            x[k] = x.get(k, 0) + 0.5
        s = sum(w[k] * v for k, v in x.items()) + bias
        s = (s * black + prior * quality.PRIOR_BYTES) / (black + quality.PRIOR_BYTES)
        assert got[d] == pytest.approx(1 / (1 + math.exp(-s)), rel=1e-3, abs=1e-5)


def test_short_and_unbroken_junk_is_judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = ["$%^&*#@! " * 3, "x" * 5000, "aGVsbG8gd29ybGQ0" * 400, "0123456789abcdef" * 300]
    fine = ["", None, "ok", "The cat sat on the mat.", "See https://example.com/a/rather/long/path?with=query for what the board decided about the new bridge."]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(junk + fine)], "doc_id long, text string")
    got = {r.doc_id - 10**6: r.keep for r in quality.op8(docs.select(F.col("doc_id").cast("long"), "text").unionByName(more)).where("doc_id >= 1000000").collect()}
    assert got == {i: i >= len(junk) for i in range(len(junk) + len(fine))}


def test_many_short_rows_take_little_memory():
    """10,000 rows in one batch are featurised in slices."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a few short words"] * 10_000)], ["text"])
    tracemalloc.start()
    for _, buf, at in quality._slices([batch]):
        quality.features(buf, at, quality.measures(buf, at)[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
