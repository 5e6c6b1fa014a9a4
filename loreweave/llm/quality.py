"""A quality classifier from weak labels.

Eight heuristics vote good, bad or nothing on each text. Expectation-maximisation
over the counts of all documents' vote patterns (3^8 at most) estimates each
labeller's accuracy and so a posterior for each pattern. The posteriors label a
bounded sample (``SAMPLE`` rows, those of smallest hash) on which a linear scorer
over hashed byte trigrams and hashed measure bins is fitted; the scorer decides on
every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import blocks, real_id, stored, texts, utf8
from loreweave.llm.hashing import Spans, lowered, words

#: Rows that the scorer is fitted on, at most (ties of the hash aside).
SAMPLE = 2000
WIDTH = 4096
#: (name, bad side, good side): a measure beyond the first votes bad, beyond the second good, between nothing.
LABELLERS = (
    ("symbols", 0.12, 0.04),
    ("upper", 0.6, 0.25),
    ("repeats", 0.25, 0.08),
    ("distinct", 0.12, 0.25),
    ("lone symbols", 0.1, 0.03),
    ("stacked marks", 0.25, 0.06),
    ("short words", 0.06, 0.15),
    ("unbroken", 0.5, 0.05),
)
GOOD, BAD, NONE = 0, 1, 2
#: Labellers that compare words need this many; the others this many bytes other than white space.
LEAST_WORDS, LEAST_BYTES = 8, 8
OF_WORDS = [1, 2, 3, 4, 6]
#: A text's score counts as much as the share of bad texts does at this many bytes.
PRIOR_BYTES = 40
#: Bytes of an unbroken run that is no word; rows of a slice.
LONG_WORD, ROWS = 64, 256

#: Kind of each byte: 0 white, 1 letter or part of one, 2 digit, 3 mark, 4 symbol.
_KIND = np.full(256, 4, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 3


def measures(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts x 8 measures, number of words, of bytes other than white space); words end where texts do."""
    kind = _KIND[buf]
    docs = np.repeat(np.arange(len(at) - 1), np.diff(at))
    per = lambda mask: np.bincount(docs[mask], minlength=len(at) - 1)
    share = lambda a, b: a / np.maximum(b, 1)
    letters = per(((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122)))
    black = per(kind > 0)
    start, end = words(buf)
    doc = np.searchsorted(at, start, "right") - 1
    n = np.bincount(doc, minlength=len(at) - 1)
    count = lambda mask: np.bincount(doc[mask], minlength=len(at) - 1)
    h = Spans(lowered(buf)).of(start, end)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(at) - 1)
    size = end - start
    lone = (size == 1) & (kind[start] == 4)
    stacked = (size > 2) & (kind[end - 1] >= 3) & (kind[np.maximum(end - 2, 0)] >= 3)
    short = (size <= 3) & (kind[start] == 1)
    long_runs = np.bincount(doc, weights=size * ((size > LONG_WORD) & (buf[start] < 128)), minlength=len(at) - 1)
    return np.stack([share(per(kind == 4), black), share(per((buf >= 65) & (buf <= 90)), letters), share(count(again), n), share(distinct, n), share(count(lone), n), share(count(stacked), n), share(count(short), n), share(long_runs, black)], axis=1), n, black


def votes(m: np.ndarray, n: np.ndarray, black: np.ndarray) -> np.ndarray:
    out = np.full(m.shape, NONE, np.int64)
    for i, (_, bad, good) in enumerate(LABELLERS):
        low = bad < good
        out[(m[:, i] <= bad) if low else (m[:, i] >= bad), i] = BAD
        out[(m[:, i] >= good) if low else (m[:, i] <= good), i] = GOOD
    few = np.zeros(out.shape, bool)
    few[:, OF_WORDS] = (n < LEAST_WORDS)[:, None]
    out[few | (black < LEAST_BYTES)[:, None]] = NONE
    return out


def features(buf: np.ndarray, at: np.ndarray, m: np.ndarray) -> np.ndarray:
    """texts x WIDTH: roots of hashed byte trigram shares, and hashed bins of the measures."""
    rows = len(at) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    if len(buf) > 2:
        b = buf.astype(np.uint32)
        code = ((b[:-2] * 40503 + b[1:-1] * 9973 + b[2:] * 613) ^ (b[:-2] << 3)) % WIDTH
        doc = np.repeat(np.arange(rows), np.diff(at))
        inner = np.flatnonzero(doc[:-2] == doc[2:])
        counts = np.bincount(doc[inner] * WIDTH + code[inner], minlength=rows * WIDTH).reshape(rows, WIDTH)
        out += np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
    bins = np.floor(8 * np.sqrt(m)).astype(np.int64)
    for i in range(m.shape[1]):
        np.add.at(out, (np.arange(rows), (bins[:, i] * 7919 + i * 104729) % WIDTH), np.float32(0.5))
    return out


def _slices(batches):
    """(slice, buf, at): texts end to end, each followed by a space so that words end; ROWS at most."""
    for part in (whole.slice(low, ROWS) for whole in blocks(batches) for low in range(0, whole.num_rows, ROWS)):
        buf, at = utf8(part.column("text"))
        n = len(at) - 1
        spaced = np.full(len(buf) + n, 32, np.uint8)
        spaced[np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(at))] = buf
        yield part, spaced, at + np.arange(n + 1)


def _vote(batches):
    for part, buf, at in _slices(batches):
        v = votes(*measures(buf, at))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(v @ 3 ** np.arange(v.shape[1]))], ["doc_id", "rid", "pattern"])


def _featurise(batches):
    for part, buf, at in _slices(batches):
        x = features(buf, at, measures(buf, at)[0])
        for i in range(len(x)):
            where = np.flatnonzero(x[i])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(i, 1), part.column("rid").slice(i, 1), pa.array([where.astype(np.int32).tobytes()], pa.binary()), pa.array([x[i][where].tobytes()], pa.binary())], ["doc_id", "rid", "at", "value"])


def accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of bad for each pattern, labellers x classes x votes probabilities), by expectation-maximisation.

    Starts from the majority vote; that labellers beat chance keeps the classes apart.
    """
    v = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    bad, good = (v == BAD).sum(1), (v == GOOD).sum(1)
    post = np.where(bad + good > 0, (bad + 0.5) / (bad + good + 1.0), 0.5)
    # One heuristic that finds fault outweighs several that find none: each looks for another fault.
    post = np.where(bad > 0, np.maximum(post, 0.9), np.minimum(post, 0.1 + 0.4 * (good == 0)))
    table = np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])  # classes x patterns
        for i in range(len(LABELLERS)):
            for x in range(3):
                table[i, :, x] = weight[:, v[:, i] == x].sum(1) + 1e-2
        table /= table.sum(2, keepdims=True)
        prior = (weight.sum(1) + 1.0) / (weight.sum() + 2.0)
        log = np.log(prior)[:, None] + sum(np.log(table[i][:, v[:, i]]) for i in range(len(LABELLERS)))
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, table


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, full batches with Adam."""
    w = np.zeros(x.shape[1] + 1)
    one, two = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))
        g = np.append((p - y).astype(x.dtype) @ x / max(1, len(y)) + decay * w[:-1], (p - y).mean() if len(y) else 0.0)
        one, two = 0.9 * one + 0.1 * g, 0.999 * two + 0.001 * g * g
        w -= rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _judge(model: tuple, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    w, bias, prior = model
    m, _, black = measures(buf, at)
    s = (features(buf, at, m) @ w.astype(np.float32) + np.float32(bias)).astype(np.float64)
    s = (s * black + prior * PRIOR_BYTES) / (black + PRIOR_BYTES)
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _score(shared):
    def run(batches):
        for part, buf, at in _slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rid"), pa.array(_judge(shared.value, buf, at))], ["doc_id", "rid", "p_bad"])

    return run


def _keep(shared, threshold: float):
    def run(batches):
        for part, buf, at in _slices(batches):
            yield part.filter(pa.array(_judge(shared.value, buf, at) < threshold))

    return run


def learned(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """(weights, bias, prior log odds of bad) of the scorer for docs."""
    rows = texts(docs).withColumn("rid", F.xxhash64("text"))
    voted = stored(rows.mapInArrow(_vote, "doc_id long, rid long, pattern long"), "votes")
    seen = voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3^8 rows at most
    patterns, counts = np.array([r.pattern for r in seen], np.int64), np.array([r.n for r in seen], np.float64)
    post, _ = accuracies(patterns, counts) if len(seen) else (np.zeros(0), None)
    named = dict(zip(patterns.tolist(), post.tolist(), strict=True))
    # The sample: rows whose hash is among the smallest.
    place = F.xxhash64("doc_id", "rid")
    cut = voted.select(place.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    x, y = np.zeros((0, WIDTH), np.float32), np.zeros(0)
    if cut is not None:
        labels = voted.where(place <= F.lit(cut)).dropDuplicates(["doc_id", "rid"])
        some = rows.where(place <= F.lit(cut)).mapInArrow(_featurise, "doc_id long, rid long, at binary, value binary").join(labels, ["doc_id", "rid"]).limit(2 * sample).collect()
        x, y = np.zeros((len(some), WIDTH), np.float32), np.array([named[r.pattern] for r in some])
        for i, r in enumerate(some):
            x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
    share = (post @ counts + 1) / (counts.sum() + 2) if len(seen) else 0.5
    return *fit(x, y), float(min(np.log(share / (1 - share)), -0.1))  # the share alone rejects no text


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """(doc_id, rid, p_bad, keep), a row for each row of docs.

    p_bad: the scorer's, which the share of bad texts among all tempers for short
    texts, never to their loss; keep: p_bad under threshold. Null or empty text: no
    labeller votes, p_bad is that share and under a half. Null doc_id and repeated rows: a row each. Empty table:
    no rows. Other columns are ignored.
    """
    rows = texts(docs).withColumn("rid", F.xxhash64("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, sample))
    scored = rows.mapInArrow(_score(shared), "doc_id long, rid long, p_bad double")
    return scored.select(real_id("doc_id"), "rid", "p_bad", (F.col("p_bad") < threshold).alias("keep"))


def without_bad(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that classify() would not keep; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, sample))
    return docs.mapInArrow(_keep(shared, threshold), docs.schema)


def op8(docs: DataFrame) -> DataFrame:
    return classify(docs).drop("rid")
