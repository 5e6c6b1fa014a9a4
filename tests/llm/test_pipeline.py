"""The pipeline's stages against plainer ways to the same rows, and the driver's contract."""

import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
from loreweave.llm import mixing, near_shingles
from loreweave.llm.common import stored
from test_dedup import DOC, edges

ROOT = Path(__file__).resolve().parents[2]


def grams(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows, least=0.8):
    """Smallest id of each row's group, by all pairs of shingle sets."""
    sets, root = {d: grams(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def edited(words, rng, changes):
    """Words with so many replaced: a near copy."""
    words = list(words)
    for i in rng.sample(range(len(words)), changes):
        words[i] = "new" + words[i]
    return " ".join(words)


def test_near_copies_are_caught_and_others_left(spark, tmp_path):
    """Near copies at similarities from 0.8 on: nine of ten caught; no text goes that has no similar text."""
    rng = random.Random(12)
    rows, pairs = [], []
    for i in range(60):
        words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(rng.choice((120, 300, 800)))]
        rows.append((2 * i, " ".join(words)))
        near = edited(words, rng, max(1, int(len(words) * rng.choice((0.005, 0.015, 0.02)))))
        rows.append((2 * i + 1, near if i % 2 else edited(words, rng, len(words) // 12)))
    groups = brute_groups(rows)
    pairs = [i for i in range(1, 120, 2) if groups[i] == i - 1]
    assert 25 < len(pairs) < 40
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOC).repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert {d for d, c in groups.items() if c == d} <= kept
    assert sum(i not in kept for i in pairs) >= 0.9 * len(pairs)


def test_a_large_group_of_near_copies_is_one_group(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(200)]
    rows = [(i, edited(words, rng, 2)) for i in range(150)] + [(1000 + i, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(50))) for i in range(50)] + [(2000, ""), (2001, None), (2002, " a b ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for giant in (20_000, 40):  # the smaller one deals places out as block pairs
        got = {r.doc_id: r.component for r in near_shingles.near_shingles(docs, giant=giant).collect()}
        assert len({got[i] for i in range(150)}) == 1 and len(set(got.values())) == 53 and got[2000] == got[2001]


def test_mix_keeps_targets_and_order(spark, tmp_path):
    """Words of each source against its target, to half a text; a source of three long texts is not lost; output in order of slots."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(20, 60)), "a", "abcd"[i % 4 - (i % 4 == 3)], 1) for i in range(400)] + [(1000 + i, " ".join(["v"] * 9000), "a", "d", 1) for i in range(3)] + [(2000, None, None, "a", 0)]
    docs = spark.createDataFrame(rows, DOC)
    target = {(r.doc_id): (r.target, r.first_slot) for r in mixing.mix(docs).collect()}
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    words = Counter()
    for r in out:
        words[r.source] += len(r.text.split())
    for i, source, room in ((0, "a", 60), (1, "b", 60), (2, "c", 60), (1000, "d", 9000)):
        assert abs(words[source] - target[i][0]) <= room
    slots = [target[r.doc_id][1] for r in {r.doc_id: r for r in reversed(out)}.values()][::-1]
    assert sum(a > b for a, b in zip(slots, slots[1:], strict=False)) < 0.1 * len(slots)


def test_stages_on_small_tables(spark, sf):
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stored(corpus_pipeline.quality_filter(spark, raw, sf), "t")
    assert kept.columns == raw.columns and 0 < kept.count() < raw.count()
    lines = stored(corpus_pipeline.drop_repeated_lines(spark, kept, sf), "t")
    assert lines.columns == raw.columns and lines.count() == kept.count()
    first, want = {}, {}
    docs = sorted((r.doc_id, r.text) for r in kept.collect())
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for d, t in docs:
        for x in t.split("\n"):
            first.setdefault(key(x), d)
    for d, t in docs:
        want[d] = "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == d)
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    near = stored(corpus_pipeline.drop_near_copies(spark, lines, sf), "t")
    groups = brute_groups([(r.doc_id, r.text) for r in lines.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, c in groups.items() if d == c)
    mixed = stored(corpus_pipeline.mix_sources(spark, near, sf), "t")
    assert mixed.columns == raw.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    last = corpus_pipeline.encode(spark, mixed, sf)
    assert last.count() == mixed.count() and last.where("not round_trip").count() == 0


def test_stages_take_odd_rows(spark, tmp_path):
    docs = edges(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, str(tmp_path)), "t")
        assert out.count() > 0, name
        if name != "sentencepiece":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert {r.doc_id for r in out.collect()} <= {5, 6, 7, 8, 9, 10, None}
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = out
    assert DOC.count(",") + 1 == len(corpus_pipeline.COLUMNS)


def test_the_rest_imports_without_this_package():
    code = "import sys; sys.modules['loreweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf' in q and not any(x.startswith('op') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
