"""SentencePiece encoding and decoding with a batched numpy Viterbi.

Texts are cut into units at places that no piece crosses; distinct units of equal
length advance together, one character a step. At each step the hashes of the
substrings that end there probe the sorted keys of the pieces, and a maximum over
the candidates stores the piece and where it starts (the backpointer).

For a unigram model the maximum is over sums of scores. The given model is a BPE
model, whose encoding is no maximum of sums. It is still a path: the one in which
each two neighbouring pieces would come out as they are if they stood alone. So
for BPE the maximum is over admissible pieces, of which a place has exactly one;
whether two pieces can be neighbours follows from how each merges by itself (traced
once per piece) and is kept. Results equal the library's for both kinds.

A unit of over ``LONG`` characters advances alone: all its substrings' hashes
probe the keys at once, and its places, a few candidates each, follow in order.

A character without a piece becomes the pieces of its bytes. The tables come from
the model file and have its size, so they are broadcast. Nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import blocks, byte_rows, real_id, texts
from loreweave.llm.hashing import Spans

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARK = SPACE.encode()
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words that a worker remembers before it starts afresh, cells of a batch.
WORDS, CELLS = 3_000_000, 1 << 19
#: Characters of a unit that advances alone, and of it places that are probed together.
LONG, STRETCH = 192, 1 << 16


def fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    at = 0
    while at < len(data):
        tag = varint()
        size = {0: 0, 1: 8, 5: 4}.get(tag & 7)
        value = varint() if tag & 7 in (0, 2) else None
        if tag & 7:
            size = value if size is None else size
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def model_type(model: bytes) -> int:
    """The file's kind of model: 1 unigram (also where it says nothing), 2 BPE."""
    trainer = next((v for k, v in fields(model) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1)


class Model:
    """Tables of a SentencePiece model, for tasks."""

    def __init__(self, path: str = MODEL):
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.size, self.unknown = n, m.unk_id()
        self.bpe = model_type(open(path, "rb").read()) == 2
        self.scores = np.array([m.get_score(i) for i in range(n)], np.float64)
        self.bytes = np.full(256, -1, np.int64)
        for i in range(n):
            if m.is_byte(i):
                self.bytes[int(pieces[i][3:5], 16)] = i
        self.longest = max(len(pieces[i]) for i in plain)
        self.chars = [np.array([ord(c) for c in pieces[i]], np.uint32) for i in range(n)]
        self.length = np.array([len(x) for x in self.chars])
        self.padded = np.zeros((n, max(self.longest, int(self.length.max()))), np.uint32)
        for i, x in enumerate(self.chars):
            self.padded[i, : len(x)] = x
        ends = hashed(self.padded)
        hashes = ends[plain, self.length[plain]]
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(plain, np.int64)[order]
        self.maybe = np.zeros(1 << 20, bool)  # leading bits of the keys: most substrings are no pieces
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        # Character pairs that stand together in some piece; words may be cut elsewhere.
        pairs = np.concatenate([(x[:-1].astype(np.uint64) << np.uint64(32)) | x[1:] for i in plain if len(x := self.chars[i]) > 1])
        self.together = np.unique(pairs)
        self.near = np.zeros(128 * 128, bool)
        x, y = (self.together >> np.uint64(32)).astype(np.int64), (self.together & np.uint64(0xFFFFFFFF)).astype(np.int64)
        plain_pair = (x < 128) & (y < 128)
        self.near[x[plain_pair] * 128 + y[plain_pair]] = True
        surfaces = [pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.bytes.tolist()):
            if i >= 0:
                surfaces[i] = bytes([b])
        for i in range(n):
            if m.is_control(i):
                surfaces[i] = b""
            if m.is_unknown(i):
                surfaces[i] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_at = np.concatenate(([0], np.cumsum([len(x) for x in surfaces])))
        self.alone = np.ones(n + 1, bool)
        if self.bpe:
            self.trace(plain)

    def probe(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        out = np.full(h.shape, -1, np.int64)
        some = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        x = h[some]
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == x, self.ids[at], -1)
        return out

    def apart(self, chars: np.ndarray) -> np.ndarray:
        """Whether each character and the next are together in no piece, so that a text may be cut between them."""
        one, two = chars[:-1], chars[1:]
        ascii_ = (one < 128) & (two < 128)
        out = ~self.near[np.where(ascii_, one * np.uint32(128) + two, 0)]
        odd = np.flatnonzero(~ascii_)
        pairs = (one[odd].astype(np.uint64) << np.uint64(32)) | two[odd]
        own, back = np.unique(pairs, return_inverse=True)
        at = np.minimum(np.searchsorted(self.together, own), len(self.together) - 1)
        out[odd] = (self.together[at] != own)[back]
        return out

    def trace(self, plain: list[int]) -> None:
        """Merges each piece from its characters, best pair first and leftmost of equals, and notes how.

        gain[p, k]: score of merge k (-inf: none); right[p, k], left[p, k]: start of
        the last and end of the first symbol after k merges; prefix: hashes.
        """
        shape = (self.size, self.padded.shape[1] + 1)
        self.gain, self.prefix = np.full(shape, -np.inf), hashed(self.padded)
        self.right, self.left = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.alone = np.ones(self.size + 1, bool)
        for n in np.unique(self.length[plain]).tolist():  # batches of equal length
            own = np.array([p for p in plain if self.length[p] == n])
            s, h = np.tile(np.arange(n + 2).clip(max=n), (len(own), 1)), self.prefix[own]
            at = np.arange(len(own))[:, None]
            self.right[own, :], self.left[own, :] = n - 1, 1
            for k in range(n - 1):
                i, j = s[:, :-2], s[:, 2:]
                piece = self.probe(span(h[at, i], h[at, j], j - i))
                score = np.where((piece >= 0) & (s[:, 1:-1] < n), self.scores[piece], -np.inf)
                best = score.argmax(1)
                self.gain[own, k] = score[at[:, 0], best]
                on = self.gain[own, k] > -np.inf
                late = (np.arange(s.shape[1] - 1) > best[:, None]) & on[:, None]
                s[:, :-1] = np.where(late, s[:, 1:], s[:, :-1])
                self.right[own, k + 1 :] = np.where(s < n, s, 0).max(1)[:, None]
                self.left[own, k + 1 :] = s[:, 1][:, None]
            self.alone[own] = s[:, 1] == n

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the characters of pieces a and b, side by side, merge into just these two.

        Each piece merges as it does alone until a pair across the border is the
        best; so the two traces are followed together, one merge a step.
        """
        out, row = np.ones(len(a), bool), np.arange(len(a))
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(row):
            x, y = a[row], b[row]
            low, high, n = self.right[x, i], self.left[y, j], self.length[x]
            tail = span(self.prefix[x, low], self.prefix[x, n], n - low)
            piece = self.probe(tail * _powers[high] + self.prefix[y, high])
            across = np.where(piece >= 0, self.scores[piece], -np.inf)
            one, two = self.gain[x, i], self.gain[y, j]
            cross = (across > one) & (across >= two) & (across > -np.inf)
            out[row[cross]] = False
            go = ~cross & (np.maximum(one, two) > -np.inf)
            first = (one >= two)[go]
            row, i, j = row[go], i[go] + first, j[go] + ~first
        return out


class Pairs:
    """Model.stays() for one pair at a time, with what it looks up as plain numbers."""

    def __init__(self, m: Model):
        self.m, self.rows, self.fits = m, {}, {}
        self.piece = dict(zip(m.keys.tolist(), m.ids.tolist(), strict=True))
        self.scores, self.powers = m.scores.tolist(), [pow(int(BASE), k, 2**64) for k in range(m.padded.shape[1] + 1)]

    def row(self, p: int) -> tuple[list, ...]:
        if p not in self.rows:
            self.rows[p] = tuple(x[p].tolist() for x in (self.m.gain, self.m.right, self.m.left, self.m.prefix))
        return self.rows[p]

    def stay(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self.followed(a, b)
        return known

    def followed(self, a: int, b: int) -> bool:
        (gain, right, _, head), (other, _, left, tail) = self.row(a), self.row(b)
        n, i, j = int(self.m.length[a]), 0, 0
        while True:
            low, high = right[i], left[j]
            h = ((head[n] - head[low] * self.powers[n - low]) * self.powers[high] + tail[high]) % 2**64
            piece = self.piece.get(h)
            across, one, two = -np.inf if piece is None else self.scores[piece], gain[i], other[j]
            if across > one and across >= two:
                return False
            if one == two == -np.inf:
                return True
            i, j = (i + 1, j) if one >= two else (i, j + 1)


def hashed(chars: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of characters: rows x (n + 1)."""
    out = np.zeros((chars.shape[0], chars.shape[1] + 1), np.uint64)
    for j in range(chars.shape[1]):
        out[:, j + 1] = out[:, j] * BASE + (chars[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


_powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(1 << 16, BASE, np.uint64))))


def long_hashed(chars: np.ndarray) -> np.ndarray:
    """As hashed() of one row, by a prefix sum over the inverse powers."""
    n = len(chars)
    up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, BASE, np.uint64))))
    down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(int(BASE), -1, 2**64), np.uint64))))
    sums = np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * down[:n])
    return np.concatenate((np.zeros(1, np.uint64), sums * up[:n]))


def span(low: np.ndarray, high: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    return high - low * _powers[np.minimum(n, len(_powers) - 1)]


class Encoder:
    """Encodes words; remembers them, and pairs of pieces that can or can't be neighbours."""

    def __init__(self, model: Model):
        self.m = model
        self.pairs = np.zeros(1 << 24, np.uint64)  # (pair, answer) in the slot of the pair's hash
        self.one_by_one = Pairs(model)
        self.forget()

    def forget(self) -> None:
        """Known words: sorted hashes with their numbers, and the pieces of each number end to end."""
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def neighbours(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b can stand side by side; a character of no piece (id size) can beside any."""
        out = np.ones(len(a), bool)
        both = np.flatnonzero((a < self.m.size) & (b < self.m.size))
        key = (a[both] * self.m.size + b[both] + 1).astype(np.uint64)  # 0 is an empty slot
        slot = ((key * BASE) >> np.uint64(40)).astype(np.int64)
        held = self.pairs[slot]
        out[both] = held & np.uint64(1)
        new = np.flatnonzero(held >> np.uint64(1) != key)
        if len(new):
            fresh, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            x, y = a[both[new[at]]], b[both[new[at]]]
            ok = self.m.stays(x, y)
            self.pairs[slot[new[at]]] = (fresh << np.uint64(1)) | ok
            out[both[new]] = ok[back]
        return out

    def viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces end to end, how many each) of words of equal length (rows of characters)."""
        m, (rows, n) = self.m, chars.shape
        h = hashed(chars)
        piece, back = np.full((rows, n + 1), -1, np.int64), np.zeros((rows, n + 1), np.int64)
        best = np.full((rows, n + 1), -np.inf)
        best[:, 0] = 0
        unknown = m.scores.min() - 10
        for j in range(1, n + 1):
            left = np.arange(rows)  # rows that may yet find a better piece; of a BPE model's only one is admissible
            for size in range(min(m.longest, j), 0, -1):
                i = j - size
                found = m.probe(span(h[left, i], h[left, j], size))
                if size == 1:
                    found = np.where(found < 0, m.size, found)
                hit = np.flatnonzero(found >= 0)
                own, p = left[hit], found[hit]
                if m.bpe:
                    keep = m.alone[p]
                    if i:
                        keep[keep] = self.neighbours(piece[own[keep], i], p[keep])
                    own, p, hit = own[keep], p[keep], hit[keep]
                    value = np.full(len(own), float(size))
                    rest = np.ones(len(left), bool)
                    rest[hit] = False
                    left = left[rest]
                else:
                    value = best[own, i] + np.where(p < m.size, m.scores[np.minimum(p, m.size - 1)], unknown)
                better = value > best[own, j]
                own, p, value = own[better], p[better], value[better]
                best[own, j], piece[own, j], back[own, j] = value, p, i
        return self.paths(chars, piece, back)

    def alone(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """viterbi() of one long word."""
        m, n = self.m, len(chars)
        h = long_hashed(chars)
        piece, back, best = [-1] * (n + 1), [0] * (n + 1), [0.0] + [-np.inf] * n
        scores, unknown = m.scores.tolist(), m.scores.min() - 10
        for low in range(1, n + 1, STRETCH):
            ends = np.arange(low, min(n + 1, low + STRETCH))
            found = np.full((len(ends), m.longest), -1, np.int32)
            for size in range(1, m.longest + 1):
                some = ends[ends >= size]
                p = m.probe(span(h[some - size], h[some], size))
                if size == 1:
                    p = np.where(p < 0, m.size, p)
                if m.bpe:
                    p = np.where(m.alone[p], p, -1)
                found[len(ends) - len(some) :, m.longest - size] = p  # longest first
            place, which = np.nonzero(found >= 0)
            for j, size, p in zip((place + low).tolist(), (m.longest - which).tolist(), found[place, which].tolist(), strict=True):
                i = j - size
                if m.bpe:
                    if piece[j] >= 0:  # a place has one admissible piece
                        continue
                    q = piece[i]
                    if i and q < m.size and p < m.size and not self.one_by_one.stay(q, p):
                        continue
                    piece[j], back[j] = p, i
                else:
                    value = best[i] + (scores[p] if p < m.size else unknown)
                    if value > best[j]:
                        best[j], piece[j], back[j] = value, p, i
        return self.paths(chars[None], np.array(piece)[None], np.array(back)[None])

    def paths(self, chars: np.ndarray, piece: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Follows the backpointers of all rows at once; a character of no piece becomes its bytes."""
        m, (rows, n) = self.m, chars.shape
        on, j, r = np.zeros((rows, n + 1), bool), np.full(rows, n), np.arange(rows)
        while len(r):
            on[r, j] = True
            j = back[r, j]
            r, j = r[j > 0], j[j > 0]
        row, end = np.nonzero(on)
        ids = piece[row, end]
        odd = np.flatnonzero(ids == m.size)
        if not len(odd):
            return ids, on.sum(1)
        size = np.ones(len(ids), np.int64)
        swaps = []
        for k in odd.tolist():
            raw = chr(chars[row[k], end[k] - 1]).encode("utf-8", "replace")
            swaps.append([int(m.bytes[b]) for b in raw] if (m.bytes >= 0).all() else [m.unknown])
            size[k] = len(swaps[-1])
        out = np.repeat(ids, size)
        place = np.cumsum(size) - size
        for k, x in zip(odd.tolist(), swaps, strict=True):
            out[place[k] : place[k] + len(x)] = x
        return out, np.bincount(row, weights=size, minlength=rows).astype(np.int64)

    def spell(self, chars: np.ndarray, low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces end to end, how many each) of the words chars[low : low + n]."""
        order = np.argsort(n, kind="stable")
        found, count = [], np.zeros(len(low), np.int64)
        edges = np.flatnonzero(np.diff(n[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            size = int(n[order[a]])
            if size > LONG:
                for k in order[a:b].tolist():
                    ids, count[[k]] = self.alone(chars[low[k] : low[k] + size])
                    found.append(ids)
                continue
            step = max(1, CELLS // (size + 1))
            for k in range(a, b, step):
                some = order[k : min(b, k + step)]
                ids, count[some] = self.viterbi(chars[low[some][:, None] + np.arange(size)])
                found.append(ids)
        ids = np.concatenate(found)
        begin = np.zeros(len(low), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        ends = np.cumsum(count)
        return ids[np.repeat(begin - (ends - count), count) + np.arange(ends[-1])], count

    def encode(self, rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all rows end to end, offsets)."""
        if len(self.known) > WORDS:
            self.forget()
        if len(self.one_by_one.fits) > WORDS // 4:
            self.one_by_one.fits.clear()
        rows = [(b" " + x).replace(MARK, b" ") if x else x for x in rows]
        edge = np.cumsum([0, *map(len, rows)])
        body = b"".join(rows)
        if not body:
            return np.zeros(0, np.int64), edge
        chars = np.frombuffer(body.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(chars) < len(body):
            edge = np.concatenate(([0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)))[edge]
        chars = np.where(chars == 32, np.uint32(ord(SPACE)), chars)
        border = np.concatenate(([True], self.m.apart(chars)))
        border[edge[:-1][edge[:-1] < len(chars)]] = True
        low = np.flatnonzero(border)
        high = np.append(low[1:], len(chars))
        h, first, code = np.unique(Spans(chars).of(low, high), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        new = np.flatnonzero(self.known[at] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            a, b = low[first[new]], high[first[new]]
            ids, n = self.spell(chars, a, b - a)
            place = np.searchsorted(self.known, h[new])
            self.number = np.insert(self.number, place, len(self.at) - 1 + np.arange(len(new)))
            self.known = np.insert(self.known, place, h[new])
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(n)))
            self.flat = np.concatenate((self.flat, ids.astype(np.int32)))
        number = self.number[np.searchsorted(self.known, h)][code]
        start, n = self.at[number], self.at[number + 1] - self.at[number]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(start - (ends - n), n) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(low, edge)]


_encoders: dict[int, Encoder] = {}


def decode_rows(m: Model, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Texts of rows of piece ids; the space before a text goes."""
    low, n = m.surface_at[ids], m.surface_at[ids + 1] - m.surface_at[ids]
    ends = np.cumsum(n)
    body = m.surface[np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    edge = np.concatenate(([0], ends))[at].tolist()
    return [body[a + (body[a : a + 1] == b" ") : b] if a < b else b"" for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _encode(shared):
    def run(batches):
        encoder = _encoders.setdefault(id(shared.value), None) or Encoder(shared.value)
        _encoders[id(shared.value)] = encoder
        for part in blocks(batches):
            raw = list(byte_rows(part.column("text")))
            ids, at = encoder.encode(raw)
            for low in range(0, len(raw), 1024):
                high = min(len(raw), low + 1024)
                own, edge = ids[at[low] : at[high]], at[low : high + 1] - at[low]
                back = decode_rows(shared.value, own, edge)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(own.astype(np.int32)))
                same = pa.array([a == b for a, b in zip(raw[low:high], back, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(low, high - low), lists, pa.array(np.diff(edge)), same], ["doc_id", "ids", "n_pieces", "round_trip"])

    return run


def encode(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip), a row for each row of docs.

    ids: the text's pieces; round_trip: they decode to the very text (false where
    it holds U+2581, the model's mark for a space, which decodes to a space).
    Null or empty text: no pieces, true. Null doc_id and repeated rows: a row
    each. Empty table: no rows. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Model(model_path))
    return texts(docs).mapInArrow(_encode(shared), "doc_id long, ids array<int>, n_pieces long, round_trip boolean").withColumn("doc_id", real_id("doc_id"))


def _decode(shared):
    def run(batches):
        for batch in batches:
            rows = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            at = np.cumsum([0, *map(len, rows)])
            text = decode_rows(shared.value, np.concatenate([np.zeros(0, np.int64), *rows]), at)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.decode("utf-8", "replace") for x in text])], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows of piece ids; null or no ids: empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Model(model_path))
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(shared), "doc_id long, text string")


def op2(docs: DataFrame) -> DataFrame:
    return encode(docs)
