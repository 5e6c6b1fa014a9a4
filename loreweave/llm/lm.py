"""Scoring texts with a log-bilinear model trained by noise-contrastive estimation.

The vocabulary is open. A token's class is itself for the end and the most
frequent words, whose number grows with the cube root of the training tokens, and
otherwise one of 120 shapes (its last letters and punctuation, by rule). The model gives p(class | two classes before), from
context vectors that meet class vectors in a product, and p(word | shape) comes
from counts over all training tokens; their product is normalised over all words.

Nothing is sampled: counts cover every training token, and the model learns from
the class trigram counts of every training document. Flow on Spark:

1. Texts become blocks (a stored table): the block's distinct token hashes, and
   its token stream as indices into them. Text is read once.
2. Distinct tokens with training counts are dealt by hash to owners, which add
   them up and answer each block, so no vocabulary is ever broadcast.
3. Each partition keeps its class trigram counts. In a round, every partition
   runs NCE over its counts from the shared parameters and the results, weighted
   by tokens, are averaged in a tree. Parameters have a fixed size.
4. Blocks meet their counts; contexts of a block are scored by one matrix product.
"""

from __future__ import annotations

import math
import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import NO_ID, blocks, byte_rows, packed, partitions, real_id, stored, texts, unpacked
from loreweave.llm.hashing import Spans, lowered, words

#: Words with vectors of their own, at least.
TOP, SUFFIXES = 135, 40
SHAPES = 3 * SUFFIXES
CLASSES = 1 + TOP + SHAPES
DIMS, NOISE, SHARED_NOISE, BATCH, RATE = 24, 16, 64, 4096, 0.15
#: A partition with few trigrams goes over them again, up to so often, for so many steps a round.
LEAST_STEPS, MOST_PASSES = 96, 24
BLOCK = 1 << 20
END = np.uint64(0)


def top_words(tokens: int) -> int:
    """How many words are classes of their own, for so many training tokens."""
    return max(TOP, int(np.cbrt(tokens)))


def held_out(doc: int) -> bool:
    return zlib.crc32(b"" if doc == NO_ID else str(doc).encode()) % 5 == 1


def shapes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Shape class (from 0) of each word: kind of last byte, and a hash of the two bytes before it or with it."""
    last = buf[end - 1]
    letter = (last >= 128) | ((last >= 97) & (last <= 122))
    kind = np.where(letter, 0, np.where((last == 46) | (last == 44), 1, 2))
    stop = np.where(letter, end, end - 1)
    one = np.where(stop > start, buf[np.maximum(stop - 1, 0)], 0).astype(np.int64)
    two = np.where(stop - 1 > start, buf[np.maximum(stop - 2, 0)], 0).astype(np.int64)
    return (kind * SUFFIXES + (one * 31 + two) % SUFFIXES).astype(np.uint8)


BLOCK_TABLE = "block long, n_train long, docs binary, words binary, tokens binary, shapes binary, train binary, stream binary"


def _tokenise(batches):
    block = TaskContext.get().partitionId() << 36
    for part in blocks(batches, most=BLOCK):
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        rows = list(byte_rows(part.column("text")))
        at = np.cumsum([0, *(len(x) + 1 for x in rows)])
        buf = lowered(np.frombuffer(b" ".join(rows), np.uint8))
        start, end = words(buf)
        tokens, first, stream = np.unique(Spans(buf).of(start, end), return_index=True, return_inverse=True)
        n = np.diff(np.searchsorted(start, at))
        train = np.array([not held_out(x) for x in ids.tolist()])
        counts = np.bincount(stream[np.repeat(train, n)], minlength=len(tokens))
        # The end is a token like others: last in the block's list, not in its stream.
        tokens, counts = np.append(tokens, END), np.append(counts, train.sum())
        shape = np.append(shapes(buf, start[first], end[first]), np.uint8(0)) if len(first) else np.zeros(1, np.uint8)
        values = (packed(ids), packed(n.astype(np.int32)), packed(tokens), shape.tobytes(), packed(counts.astype(np.int32)), small(stream))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([counts.sum()], pa.int64()), *(pa.array([x], pa.binary()) for x in values)], [x.split()[0] for x in BLOCK_TABLE.split(", ")])
        block += 1


def small(values: np.ndarray) -> bytes:
    """Numbers from 0 in two, four or eight bytes each, as the largest needs."""
    most = int(values.max()) if len(values) else 0
    return packed(values.astype(np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64))


def wide(data: bytes, n: int) -> np.ndarray:
    """n numbers written by small()."""
    return unpacked(data, {2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]).astype(np.int64) if n else np.zeros(0, np.int64)


def _by_owner(tokens: np.ndarray, owners: int) -> list[np.ndarray]:
    owner = (tokens % np.uint64(owners)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(owners + 1))
    return [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _ask(owners: int):
    def run(batches):
        for batch in batches:
            for block, tokens, shape, train in zip(*(batch.column(x).to_pylist() for x in ("block", "tokens", "shapes", "train")), strict=True):
                tokens, shape, train = unpacked(tokens, np.uint64), np.frombuffer(shape, np.uint8), unpacked(train, np.int32)
                rows = [(o, block, packed(tokens[i]), shape[i].tobytes(), packed(train[i])) for o, i in enumerate(_by_owner(tokens, owners)) if len(i)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["owner", "block", "tokens", "shapes", "train"])

    return run


def _merge_stats(top: int):
    return lambda parts: _merged_stats(parts, top)


def _merged_stats(parts: list[dict], top: int) -> dict:
    tops = sorted({x for p in parts for x in p["top"]}, key=lambda x: (-x[1], x[0]))[:top]
    return {"n": sum(p["n"] for p in parts), "v": sum(p["v"] for p in parts), "top": tops, "shape_n": sum(p["shape_n"] for p in parts), "shape_v": sum(p["shape_v"] for p in parts)}


def _answer(top: int):
    """Owner: adds up its tokens' counts; a row back to each block, and one of statistics (block -1)."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for owner, *row in zip(*(batch.column(x).to_pylist() for x in ("owner", "block", "tokens", "shapes", "train")), strict=True):
                held.setdefault(owner, []).append(row)
        for owner, rows in held.items():
            tokens = np.concatenate([unpacked(x[1], np.uint64) for x in rows])
            shape = np.concatenate([np.frombuffer(x[2], np.uint8) for x in rows])
            train = np.concatenate([unpacked(x[3], np.int32) for x in rows])
            own, first, back = np.unique(tokens, return_index=True, return_inverse=True)
            total = np.bincount(back, weights=train, minlength=len(own)).astype(np.int64)
            word = (own != END) & (total > 0)
            kinds = shape[first][word]
            best = np.lexsort((own, -total))
            best = best[word[best]][:top]
            stats = {
                "n": int(total.sum()), "v": int((total > 0).sum()), "top": [(int(own[i]), int(total[i]), int(shape[first[i]])) for i in best],
                "shape_n": np.bincount(kinds, weights=total[word], minlength=SHAPES), "shape_v": np.bincount(kinds, minlength=SHAPES),
            }
            answers, at = [(-1, owner, pickle.dumps(stats))], 0
            for block, some, *_ in rows:
                n = len(some) // 8
                answers.append((block, owner, small(total[back[at : at + n]])))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*answers, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "owner", "counts"])

    return run


def _tree(parts: DataFrame, merge, fan: int) -> bytes | None:
    """One value out of (value binary) rows, merged in two steps on the executors."""

    def run(batches):
        held = [pickle.loads(x) for batch in batches for x in batch.column("value").to_pylist()]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(merge(held))], pa.binary())], ["value"])

    out = parts.repartition(fan).mapInArrow(run, "value binary").coalesce(1).mapInArrow(run, "value binary").collect()
    return pickle.loads(out[0].value) if out else None


def top_size(top: np.ndarray) -> int:
    return max(TOP, len(top))


def classes(tokens: np.ndarray, shape: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Class of each of a block's tokens. top: hashes of the frequent words, most frequent first."""
    out = 1 + top_size(top) + shape.astype(np.int64)
    if len(top):
        order = np.argsort(top)
        at = np.minimum(np.searchsorted(top[order], tokens), len(top) - 1)
        hit = top[order][at] == tokens
        out[hit] = 1 + order[at[hit]]
    out[tokens == END] = 0
    return out


def sequence(n: np.ndarray, stream: np.ndarray, own: np.ndarray, size_of_class: int = CLASSES) -> tuple[np.ndarray, ...]:
    """(doc, token, class, context) of a block's tokens with ends; context: the two classes before, the end's before a text."""
    size = n + 1
    end = np.cumsum(size) - 1
    doc = np.repeat(np.arange(len(n)), size)
    token = np.full(len(doc), len(own) - 1, np.int64)
    inner = np.ones(len(doc), bool)
    inner[end] = False
    token[inner] = stream
    cls = own[token].astype(np.int64)
    one, two = np.zeros_like(cls), np.zeros_like(cls)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    two[end + 1 - size] = 0
    return doc, token, cls, two * size_of_class + one


def _grams(top: np.ndarray):
    def run(batches):
        codes, counts, size = [], [], 1 + top_size(top) + SHAPES
        for batch in batches:
            for docs, n, tokens, shape, stream in zip(*(batch.column(x).to_pylist() for x in ("docs", "words", "tokens", "shapes", "stream")), strict=True):
                own, n = classes(unpacked(tokens, np.uint64), np.frombuffer(shape, np.uint8), top), unpacked(n, np.int32).astype(np.int64)
                doc, _, cls, context = sequence(n, wide(stream, int(n.sum())), own, size)
                train = np.array([not held_out(x) for x in unpacked(docs, np.int64).tolist()])
                code, count = np.unique((context * size + cls)[train[doc]].astype(np.uint64), return_counts=True)
                codes.append(code)
                counts.append(count)
                if sum(map(len, codes)) > 1 << 20:
                    codes, counts = ([x] for x in _summed(codes, counts))
        if codes:
            code, count = _summed(codes, counts)
            for low in range(0, len(code), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([packed(x[low : low + (1 << 20)])], pa.binary()) for x in (code, count)], ["codes", "counts"])

    return run


def _summed(codes, counts):
    own, back = np.unique(np.concatenate(codes), return_inverse=True)
    return own, np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)


def fresh(unigram: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Parameters at the start: the unigram, and small vectors. Squares: AdaGrad's sums."""
    rng, n = np.random.default_rng(seed), len(unigram)
    p = {"words": rng.normal(0, 0.1, (n, DIMS)), "out": rng.normal(0, 0.1, (n, DIMS)), "first": np.eye(DIMS), "second": np.eye(DIMS) * 0.5, "bias": np.log(unigram)}
    return {k: v.astype(np.float32) for k, v in p.items()} | {f"{k}_sq": np.full(v.shape, 0.05, np.float32) for k, v in p.items()}


def logits(p: dict, context: np.ndarray) -> np.ndarray:
    """Scores of all classes in each context (contexts x classes)."""
    one, two = p["words"] @ p["first"].T, p["words"] @ p["second"].T
    n = len(p["bias"])
    return (one[context % n] + two[context // n]) @ p["out"].T + p["bias"]


def log10_probabilities(p: dict, context: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log10 p(cls | context), normalised; equal contexts are scored once."""
    step = max(64, (1 << 19) // len(p["bias"]))
    own, back = np.unique(context, return_inverse=True)
    out = np.empty(len(context))
    order = np.argsort(back, kind="stable")
    ends = np.searchsorted(back[order], np.arange(0, len(own) + step, step))
    for i, low in enumerate(range(0, len(own), step)):
        s = logits(p, own[low : low + step])
        s -= s.max(axis=1, keepdims=True)
        here = order[ends[i] : ends[i + 1]]
        row = back[here] - low
        got = s[row, cls[here]].astype(np.float64)
        np.exp(s, out=s)
        out[here] = got - np.log(s.sum(axis=1, dtype=np.float64))[row]
    return out / math.log(10)


def nce_epoch(p: dict, code: np.ndarray, count: np.ndarray, unigram: np.ndarray, seed: int) -> dict:
    """One pass over class trigrams with counts: data against NOISE noise classes for each, drawn from the unigram."""
    rng, size = np.random.default_rng(seed), len(unigram)
    p = {k: v.copy() for k, v in p.items()}
    floor = np.log(NOISE * unigram).astype(np.float32)
    order = rng.permutation(len(code))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def step(name, gradient):
        p[f"{name}_sq"] += gradient * gradient
        p[name] += RATE * gradient / np.sqrt(p[f"{name}_sq"])

    def scatter(index, rows):
        out, order = np.zeros((size, DIMS), np.float32), np.argsort(index.astype(np.uint16 if size < 1 << 16 else np.int64), kind="stable")
        own = index[order]
        new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[new]] = np.add.reduceat(rows[order].astype(np.float32), new, axis=0)
        return out

    for low in range(0, len(code), BATCH):
        i = order[low : low + BATCH]
        w, context = (code[i] % code.dtype.type(size)).astype(np.int64), (code[i] // code.dtype.type(size)).astype(np.int64)
        a, b = context % size, context // size
        weight = (count[i] / count[i].mean()).astype(np.float32)
        r1, r2 = p["words"][a], p["words"][b]
        hidden = r1 @ p["first"].T + r2 @ p["second"].T
        noise = rng.choice(size, SHARED_NOISE, p=unigram)
        pull = weight * (1 - sigmoid((hidden * p["out"][w]).sum(1) + p["bias"][w] - floor[w]))
        push = -(NOISE / SHARED_NOISE) * weight[:, None] * sigmoid(hidden @ p["out"][noise].T + p["bias"][noise] - floor[noise])
        n = np.float32(len(i))
        d_hidden = (pull[:, None] * p["out"][w] + push @ p["out"][noise]) / n
        d_out = scatter(w, pull[:, None] * hidden)
        np.add.at(d_out, noise, push.T @ hidden)
        d_bias = np.bincount(w, weights=pull, minlength=size) + np.bincount(noise, weights=push.sum(0), minlength=size)
        d_words = scatter(a, d_hidden @ p["first"]) + scatter(b, d_hidden @ p["second"])
        d_first, d_second = d_hidden.T @ r1, d_hidden.T @ r2
        for name, gradient in (("out", d_out / n), ("bias", (d_bias / n).astype(np.float32)), ("words", d_words), ("first", d_first), ("second", d_second)):
            step(name, gradient)
    return p


def _round(shared, unigram, seed: int):
    def run(batches):
        task = TaskContext.get().partitionId()
        p, n = None, 0
        for batch in batches:
            for codes, counts in zip(*(batch.column(x).to_pylist() for x in ("codes", "counts")), strict=True):
                code, count = unpacked(codes, np.uint64), unpacked(counts, np.int64)
                for again in range(min(MOST_PASSES, -(-LEAST_STEPS * BATCH // max(1, len(code))))):
                    p = nce_epoch(p or shared.value, code, count, unigram, (seed * MOST_PASSES + again) * 1_000_003 + task)
                n += int(count.sum())
        if p:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((n, {k: v * np.float64(n) for k, v in p.items()}))], pa.binary())], ["value"])

    return run


def _average(parts: list) -> tuple:
    return sum(n for n, _ in parts), {k: sum(p[k] for _, p in parts) for k in parts[0][1]}


def train(grams: DataFrame, unigram: np.ndarray, rounds: int = 4) -> dict:
    """Parameters after some rounds over all (codes, counts) rows."""
    spark, p = grams.sparkSession, fresh(unigram)
    for i in range(rounds):
        shared = spark.sparkContext.broadcast(p)
        found = _tree(grams.mapInArrow(_round(shared, unigram, i), "value binary"), _average, max(1, int(partitions(spark) ** 0.5)))
        if found is None:  # no training tokens
            break
        p = {k: (v / found[0]).astype(np.float32) for k, v in found[1].items()}
    return p


def _score(shared, owners: int):
    def run(batches):
        p, stats, top, shape_n, shape_v = shared.value
        den = stats["n"] + 0.5 * (stats["v"] + 1)
        shape_log = np.log10(shape_n + 0.5 * (shape_v + 1))
        n_top = top_size(top)
        for batch in batches:
            cols = (batch.column(x).to_pylist() for x in ("docs", "words", "tokens", "shapes", "stream", "counts"))
            for docs, n, tokens, shape, stream, counts in zip(*cols, strict=True):
                docs, n, tokens, shape = unpacked(docs, np.int64), unpacked(n, np.int32).astype(np.int64), unpacked(tokens, np.uint64), np.frombuffer(shape, np.uint8)
                total = np.zeros(len(tokens), np.int64)
                places = _by_owner(tokens, owners)
                for x in counts:
                    place = places[x["owner"]]
                    total[place] = wide(x["counts"], len(place))
                own = classes(tokens, shape, top)
                doc, token, cls, context = sequence(n, wide(stream, int(n.sum())), own, 1 + n_top + SHAPES)
                log = np.log10(total + 0.5)
                within = np.where(own > n_top, log - shape_log[shape], 0.0)
                base = np.bincount(doc, weights=(log - math.log10(den))[token], minlength=len(docs))
                score = np.bincount(doc, weights=log10_probabilities(p, context, cls) + within[token], minlength=len(docs))
                known = np.bincount(doc, weights=(total > 0)[token], minlength=len(docs)).astype(np.int64)
                values = (docs, np.array([held_out(x) for x in docs.tolist()], bool), n + 1, known, np.full(len(docs), stats["n"], np.int64), base, score)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in values], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, rounds: int = 4) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs.

    Learns from rows whose crc32 of the doc_id as text leaves another remainder
    by 5 than 1. base_score: the smoothed unigram; score: the model. Both log10.

    Null or empty text: its end is its one token. Null doc_id: a training row.
    Repeated rows count each time. Empty table: no rows; no training rows: all
    tokens are unknown and the model is its start. Other columns are ignored.
    """
    spark = docs.sparkSession
    owners = partitions(spark)
    table = stored(texts(docs).mapInArrow(_tokenise, BLOCK_TABLE), "lm-blocks")
    n_top = top_words(table.agg(F.sum("n_train")).first()[0] or 0)
    asked = table.select("block", "tokens", "shapes", "train").mapInArrow(_ask(owners), "owner int, block long, tokens binary, shapes binary, train binary")
    counts = stored(asked.repartitionById(owners, F.col("owner")).mapInArrow(_answer(n_top), "block long, owner int, counts binary"), "lm-counts")
    fan = max(1, int(owners**0.5))
    empty = {"n": 0, "v": 0, "top": [], "shape_n": np.zeros(SHAPES), "shape_v": np.zeros(SHAPES)}
    stats = _tree(counts.where("block = -1").select(F.col("counts").alias("value")), _merge_stats(n_top), fan) or empty
    top = np.array([x[0] for x in stats["top"]], np.uint64)
    shape_n, shape_v = stats["shape_n"].copy(), stats["shape_v"].copy()
    for _, count, shape in stats["top"]:  # frequent words are classes of their own
        shape_n[shape] -= count
        shape_v[shape] -= 1
    ends = stats["n"] - sum(x[1] for x in stats["top"]) - shape_n.sum()
    mass = np.zeros(1 + top_size(top) + SHAPES)
    mass[0], mass[1 : 1 + len(top)], mass[1 + top_size(top) :] = ends, [x[1] for x in stats["top"]], shape_n
    unigram = (mass + 0.5) / (mass + 0.5).sum()
    grams = stored(table.select("docs", "words", "tokens", "shapes", "stream").mapInArrow(_grams(top), "codes binary, counts binary"), "lm-grams")
    p = train(grams, unigram, rounds)
    shared = spark.sparkContext.broadcast((p, {k: stats[k] for k in ("n", "v")}, top, shape_n, shape_v))
    answers = counts.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("owner", "counts")).alias("counts"))
    out = table.select("block", "docs", "words", "tokens", "shapes", "stream").join(answers, "block").mapInArrow(_score(shared, owners), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", real_id("doc_id"))


def op4(docs: DataFrame) -> DataFrame:
    return score_texts(docs)
