"""Toxicity by the nearest labelled examples.

Terms are runs of letters, digits and non-ASCII bytes, A-Z in lower case. The
vocabulary is what goes with the label: terms whose log-likelihood ratio over the
examples is ``EVIDENCE`` at least, that a part ``SUPPORT`` of the toxic examples
holds and that raise the share of toxic ones by a part ``LIFT`` of what it lacks
to one; so neither chance nor a group of near copies makes a term. Its document frequencies come from all
documents. Texts and examples are TF-IDF vectors over it (1 + ln tf; ln of all
documents by those with the term, plus 1), of unit length.

Examples with the same terms are one vector with its numbers of rows. An inverted
index holds the postings of each term by blocks of examples with each block's
largest weight; a text visits blocks by falling bound and stops once the bound
is below its k-th cosine, so the k nearest are exact. They vote by rows, weighted
by distance, and a share of the votes goes to the examples' toxic share.

The examples are a bounded sample (``EXAMPLES`` labelled rows, those of smallest
hash of doc_id); every document is counted and scored, and none is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import blocks, byte_rows, real_id, stored, texts

#: Labelled rows that are examples, and terms of the vocabulary, at most.
EXAMPLES, TERMS = 16384, 4096
EVIDENCE, SUPPORT, LIFT = 30.0, 0.02, 0.25
#: Examples that vote; how many rows the share of all counts for; examples of a block.
K, PRIOR, BLOCK = 25, 0.5, 64
#: Bytes that are cut into words at a time.
PIECE = 1 << 20
_WORD, _GAP = re.compile(rb"[a-z0-9\x80-\xff]+"), re.compile(rb"[^a-z0-9\x80-\xff]")


def words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces that end between terms."""
    text, low = text.lower(), 0
    while low < len(text):
        gap = _GAP.search(text, low + PIECE)
        high = gap.start() if gap else len(text)
        yield _WORD.findall(text, low, high)
        low = high


def counted(text: bytes, place: dict[bytes, int]) -> dict[int, int]:
    """How often each term of the vocabulary is in the text, by its place there."""
    found: Counter = Counter()
    for piece in words(text):
        found.update(place[w] for w in piece if w in place)
    return dict(sorted(found.items()))


class Index:
    """Postings of the examples' distinct vectors, by term and block."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[dict[int, int], int, int]]):
        """examples: (term counts, rows, toxic rows) of distinct term counts."""
        self.idf = idf
        self.rows, self.toxic = (np.array([e[i] for e in examples], np.float64) for i in (1, 2))
        self.share = (self.toxic.sum() + 0.5) / (self.rows.sum() + 5)
        postings = [(t, i, w) for i, e in enumerate(examples) for t, w in zip(*self.vector(e[0]), strict=True)]
        postings.sort()
        term, self.example, self.weight = (np.array([p[i] for p in postings], (np.int64, np.int64, np.float64)[i]) for i in range(3))
        self.n_blocks = -(-len(examples) // BLOCK)
        #: Postings of term t and block b: from starts[t, b] to starts[t, b + 1].
        cell = np.arange(len(idf))[:, None] * self.n_blocks + np.arange(self.n_blocks + 1)
        self.starts = np.searchsorted(term * self.n_blocks + self.example // BLOCK, cell)
        self.largest = np.zeros((len(idf), self.n_blocks))
        np.maximum.at(self.largest, (term, self.example // BLOCK), self.weight)
        self.visited = 0

    def vector(self, counts: dict[int, int]) -> tuple[list[int], list[float]]:
        terms = list(counts)
        w = (1 + np.log([counts[t] for t in terms])) * self.idf[terms] if terms else np.zeros(0)
        return terms, (w / np.sqrt((w * w).sum())).tolist() if terms else []

    def nearest(self, counts: dict[int, int], k: int = K) -> list[tuple[int, float]]:
        """(example, cosine) of the k nearest with a cosine over 0; ties, at 12 places, to the earlier example."""
        terms, weights = self.vector(counts)
        if not terms or not self.n_blocks:
            return []
        bound = np.array(weights) @ self.largest[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] + 1e-9 < -best[-1][0]:
                break
            self.visited += 1
            score = np.zeros(BLOCK)
            for t, w in zip(terms, weights, strict=True):
                own = slice(self.starts[t, b], self.starts[t, b + 1])
                score[self.example[own] - b * BLOCK] += w * self.weight[own]
            score = np.round(score, 12)
            best = sorted([*best, *((-score[i], b * BLOCK + int(i)) for i in np.flatnonzero(score > 0))])[:k]
        return [(i, float(-s)) for s, i in best]

    def vote(self, near: list[tuple[int, float]], blank: tuple[float, float]) -> float:
        """The share of toxic rows among the voters; blank: (rows, toxic rows) of examples without terms, for a text without any."""
        if near:
            w = np.array([1 / (1.05 - min(1.0, s)) for _, s in near]) / 20
            at = [i for i, _ in near]
            rows, toxic = w @ self.rows[at], w @ self.toxic[at]
        else:
            rows, toxic = blank
        return float((toxic + PRIOR * self.share) / (rows + PRIOR))


def log_likelihood(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Dunning's ratio of (examples with the term, without) x (toxic, clean)."""

    def part(seen, expected):
        return seen * np.log(np.where(seen > 0, seen, 1) / np.where(expected > 0, expected, 1))

    n, held = n_toxic + n_clean, toxic + clean
    cells = ((toxic, held * n_toxic / n), (clean, held * n_clean / n), (n_toxic - toxic, (n - held) * n_toxic / n), (n_clean - clean, (n - held) * n_clean / n))
    return 2 * sum(part(*c) for c in cells)


def sampled(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(text, toxic) of the examples: labelled documents whose crc32(doc_id as text) mod 4 is not 2, distinct by text.

    A document with several labels is toxic if half of them say so. Bounded by
    examples twice: labelled ids, then documents that have them.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The labels' side has examples rows of 9 bytes at most.
    met = held.join(F.broadcast(known), "doc_id").select("text", "toxic", F.md5(F.col("text").cast("binary")).alias("print"))
    few = met.select("print").distinct().orderBy("print").limit(examples)
    return met.join(F.broadcast(few), "print").groupBy("print").agg(F.min("text").alias("text"), (F.avg(F.col("toxic").cast("int")) >= 0.5).alias("toxic"))


def _distinct(batches):
    """(term, toxic 0 or 1, clean 0 or 1) for each distinct term of each example."""
    for batch in (b for whole in batches for b in blocks([whole])):
        terms, toxic = [], []
        for text, y in zip(byte_rows(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
            own = sorted({w for piece in words(text) for w in piece})
            terms += own
            toxic += [int(y)] * len(own)
        y = np.array(toxic, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array(y), pa.array(1 - y)], ["term", "toxic", "clean"])


def vocabulary(examples: DataFrame, terms: int = TERMS) -> list[bytes]:
    """The terms that go with the label, strongest first; ties by their bytes."""
    n = examples.agg(F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("toxic"), F.count("*").alias("all")).first()
    if not n.toxic or n.toxic == n["all"]:
        return []
    held = examples.mapInArrow(_distinct, "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    base = n.toxic / n["all"]
    raised = F.col("toxic") / (F.col("toxic") + F.col("clean")) >= base + LIFT * (1 - base)

    @F.pandas_udf("double")
    def ratio(toxic, clean):
        import pandas as pd

        return pd.Series(log_likelihood(toxic.to_numpy(np.float64), clean.to_numpy(np.float64), n.toxic, n["all"] - n.toxic))

    # A term of fewer toxic examples can't reach EVIDENCE, or has not the support.
    least = max(EVIDENCE / (-2 * np.log(base)), SUPPORT * n.toxic)
    strong = held.where(raised & (F.col("toxic") >= least)).withColumn("ratio", ratio("toxic", "clean")).where(F.col("ratio") >= EVIDENCE)
    return [bytes(r.term) for r in strong.orderBy(F.col("ratio").desc(), "term").limit(terms).collect()]


def _count(shared, more: tuple[str, ...]):
    def run(batches):
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in blocks(batches):
            found = [counted(text, place) for text in byte_rows(batch.column("text"))]
            terms, tf = ([list(f) for f in found], pa.list_(pa.int32())), ([list(f.values()) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(*terms), pa.array(*tf)], [*more, "terms", "tf"])

    return run


def _score(shared, k: int):
    index, blank, names = shared

    def run(batches):
        model = index.value

        @lru_cache(1 << 16)
        def one(key: tuple) -> tuple:
            near = model.nearest(dict(key), k)
            return model.vote(near, blank), [(i, s) for i, s in near[:3]]

        for batch in batches:
            keys = [tuple(zip(t, n, strict=True)) for t, n in zip(batch.column("terms").to_pylist(), batch.column("tf").to_pylist(), strict=True)]
            found = [one(x) for x in keys]
            said = [[names[t] for t, _ in x] for x in keys]
            near = [[{"example": i, "cosine": s} for i, s in f[1]] for f in found]
            kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.float64()), pa.array(said, pa.list_(pa.string())), pa.array(near, kind)], ["doc_id", "score", "terms", "nearest"])

    return run


def index_of(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int = TERMS) -> tuple[Index, tuple[float, float], list[str], DataFrame]:
    """(index, (rows, toxic rows) of examples without terms, the vocabulary, (doc_id, terms, tf) of all documents)."""
    spark = docs.sparkSession
    some = stored(sampled(docs, labels, examples), "toxic-examples")
    names = vocabulary(some, terms)
    shared = spark.sparkContext.broadcast(names)
    held = stored(texts(docs).mapInArrow(_count(shared, ("doc_id",)), "doc_id long, terms array<int>, tf array<long>"), "toxic-terms")
    n = held.count()
    df = np.zeros(len(names))
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term
        df[r.t] = r["count"]
    seen = some.mapInArrow(_count(shared, ("toxic",)), "toxic boolean, terms array<int>, tf array<long>")
    same = seen.groupBy("terms", "tf").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).collect()  # examples at most
    same.sort(key=lambda r: (r.terms, r.tf))
    blank = next(((r.n, r.toxic) for r in same if not r.terms), (0, 0))
    model = Index(np.log(max(1, n) / np.maximum(df, 1)) + 1, [(dict(zip(r.terms, r.tf, strict=True)), r.n, r.toxic) for r in same if r.terms])
    model.share = (blank[1] + model.toxic.sum() + 0.5) / (blank[0] + model.rows.sum() + 5)
    return model, blank, [t.decode("utf-8", "replace") for t in names], held


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, k: int = K, examples: int = EXAMPLES, terms: int = TERMS) -> DataFrame:
    """(doc_id, held_out, score, predicted, terms, nearest), a row for each row of docs.

    score: what the k nearest examples vote, 0 to 1, of the text alone. terms: those
    of the vocabulary in the text; nearest: the first three examples (by number)
    with their cosines. Null or empty text and texts without a term of the
    vocabulary: the share of toxic rows among such examples. Null doc_id: scored,
    held_out false. Repeated rows: a row each. Equal cosines: the example whose
    terms sort first. No labels, or of one class: no term, and that share (0.1
    without any). Empty table: no rows. Other columns are ignored.
    """
    model, blank, names, held = index_of(docs, labels, examples, terms)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    told = held.mapInArrow(_score((shared, blank, names), k), "doc_id long, score double, terms array<string>, nearest array<struct<example:long,cosine:double>>")
    out = F.coalesce(F.crc32(real_id("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return told.select(real_id("doc_id"), out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "terms", "nearest")


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)
