"""Terms of a glossary found in texts by automata (Aho-Corasick), a pass over each text.

Entries are dealt out over a grid of tasks by their number, texts over its columns.
A task builds one automaton of its entries' terms, then texts stream past it. No term
goes through the driver, and ``MOST_CHARS`` bounds what an automaton holds.
"""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.sources.shared import stored

#: Characters of terms that a task holds; pairs that it hands on at a time.
MOST_CHARS, PAIRS = 1 << 23, 1 << 16


def automaton(terms: list[tuple[str, int]]) -> ahocorasick.Automaton | None:
    """Of (term, number) pairs: an automaton whose values are the numbers of a term; None without terms."""
    by_term: dict[str, list[int]] = {}
    for term, number in terms:
        if term:
            by_term.setdefault(term, []).append(number)
    if not by_term:
        return None
    out = ahocorasick.Automaton()
    for term, numbers in by_term.items():
        out.add_word(term, tuple(numbers))
    out.make_automaton()
    return out


def spotted(found: ahocorasick.Automaton | None, text: str) -> set[int]:
    """Numbers of the terms in a text, wherever they begin."""
    return set() if found is None or not text else {n for _, numbers in found.iter(text) for n in numbers}


class _Entries:
    """Entries with their terms, found in texts by one automaton of the distinct terms."""

    def __init__(self, parts: list[pa.RecordBatch]):
        terms = [p.column("terms") for p in parts]
        size = np.concatenate([t.value_lengths().to_numpy() for t in terms])
        coded = pa.concat_arrays([t.flatten() for t in terms]).dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        self.entries = pa.concat_arrays([p.column("entry") for p in parts])
        self.row = np.repeat(np.arange(len(size)), size)[order]
        self.bounds = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        self.automaton = automaton([(t, i) for i, t in enumerate(coded.dictionary.to_pylist())])

    def rows(self, low: str) -> np.ndarray:
        """Those of the entries that a text mentions, each once."""
        own = [self.row[self.bounds[i] : self.bounds[i + 1]] for i in spotted(self.automaton, low)]
        return np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)

    def pairs(self, texts: pa.RecordBatch):
        """Batches (query, entry) of texts (query, low), over PAIRS rows each but for the last."""
        at, found, held = [], [], 0
        for i, low in enumerate([*texts.column("low").to_pylist(), None]):
            own = self.rows(low)
            at.append(np.full(len(own), i))
            found.append(own)
            held += len(own)
            if held > (PAIRS if i < texts.num_rows else 0):
                columns = [texts.column("query").take(pa.array(np.concatenate(at))), self.entries.take(pa.array(np.concatenate(found)))]
                yield pa.RecordBatch.from_arrays(columns, ["query", "entry"])
                at, found, held = [], [], 0


def _spot(batches):
    """A task's cells: the entries (kind 0) come first and are held, texts pass."""
    cell, parts, held = None, [], None
    for batch in batches:
        cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        turn = np.flatnonzero(np.concatenate(([True], (cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]))))
        for low, high in zip(turn, [*turn[1:], batch.num_rows], strict=True):
            some = batch.slice(low, high - low)
            if cells[low] != cell:
                cell, parts, held = cells[low], [], None
            if kinds[low] == 0:
                parts.append(some)
                continue
            if parts:
                held, parts = _Entries(parts), []
            if held is not None:
                yield from held.pairs(some)


def mentions(queries: DataFrame, glossary: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """(query, entry) of queries (query, text) and glossary (entry, terms): a term is a substring, whatever the case; each pair once.

    Null and empty terms are in no text; null text has none. Queries and entries of
    any type; repeated queries: their pairs once. The grid has as many rows as bound
    a task's terms, or more where that moves fewer characters.
    """
    lowered = F.array_distinct(F.filter(F.transform("terms", F.lower), lambda t: t.isNotNull() & (t != "")))
    terms = stored(glossary.where("entry is not null").select("entry", lowered.alias("terms")).where(F.size("terms") > 0), "terms")
    asked = queries.select("query", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    size = terms.agg(F.sum(F.length(F.array_join("terms", "")))).first()[0] or 0
    passing = asked.agg(F.sum(F.length("low"))).first()[0] or 0
    n = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = max(-(-2 * size // most_chars) if size > most_chars else 1, min(n, round(math.sqrt(n * size / max(passing, 1)))))
    columns = max(1, n // lines)

    def dealt(df: DataFrame, cells: Column, kind: int) -> DataFrame:
        cols = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
        return df.select(F.explode(cells.cast("array<int>")).alias("cell"), F.lit(kind).alias("kind"), *cols)

    kinds = {"entry": terms.schema["entry"].dataType, "terms": "array<string>", "query": asked.schema["query"].dataType, "low": "string"}
    line, column = F.pmod(F.xxhash64("entry"), F.lit(lines)), F.pmod(F.xxhash64("query", "low"), F.lit(columns))
    left = dealt(terms, F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: line * columns + c), 0)
    right = dealt(asked, F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda r: r * columns + column), 1)
    work = left.unionByName(right).repartitionById(lines * columns, F.col("cell")).sortWithinPartitions("cell", "kind")
    schema = f"query {kinds['query'].simpleString()}, entry {kinds['entry'].simpleString()}"
    return work.mapInArrow(_spot, schema).distinct()
