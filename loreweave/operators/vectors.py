"""Sparse and dense vectors, and top-k search over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import tokens
from loreweave.operators import sparse_index
from loreweave.sources.shared import spread, stored


#: Tokens that a task counts at a time, and bytes of terms and numbers that it holds while it sums up their counts.
COUNTED, SUMMED = 1 << 20, 1 << 26


def _slices(size: np.ndarray, most: int):
    """Ranges of rows with most elements together; a longer row is a range of its own."""
    at, low = np.concatenate(([0], np.cumsum(size))), 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high
        low = high


def _list_of(bounds: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def _counted(batches):
    """Of each row (id, tokens) its distinct terms, how often it has them and where first."""
    for batch in batches:
        for low, high in _slices(batch.column("tokens").value_lengths().to_numpy(), COUNTED):
            ids, tokens = (batch.column(c).slice(low, high - low) for c in ("id", "tokens"))
            size = tokens.value_lengths().to_numpy().astype(np.int64)
            start = np.concatenate(([0], np.cumsum(size)))
            coded = tokens.flatten().dictionary_encode()
            width = max(1, len(coded.dictionary))
            key = np.repeat(np.arange(len(size)), size) * width + coded.indices.to_numpy().astype(np.int64)
            own, first, tf = np.unique(key, return_index=True, return_counts=True)
            row = own // width
            bounds = np.searchsorted(row, np.arange(len(size) + 1))
            columns = (coded.dictionary.take(pa.array(own % width)), pa.array(tf.astype(np.int64)), pa.array((first - start[row]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids, *(_list_of(bounds, c) for c in columns)], ["id", "terms", "tfs", "firsts"])


def counted_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, terms, tfs, firsts): of each id its distinct terms, their occurrences and first places.

    Counted within the row, so no term is shuffled. Rows that share an id (null is
    one) are counted together: these alone meet in a shuffle. Null texts have no terms.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = spread(docs.select(F.col(id_col).alias("id"), text_col)).select("id", tokens(text_col).alias("tokens"))
    rows = rows.mapInArrow(_counted, f"id {kind}, terms array<string>, tfs array<bigint>, firsts array<int>")
    again = stored(docs.groupBy(F.col(id_col).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "repeated-ids")
    if again.isEmpty():
        return rows
    same = F.col("id").eqNullSafe(F.col("again"))
    met = unpacked_counts(rows.join(again, same, "left_semi")).groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.min("first").alias("first"))
    lists = F.array_sort(F.collect_list(F.struct("term", "tf", "first")))
    whole = met.groupBy("id").agg(lists.alias("v")).select("id", F.col("v.term").alias("terms"), F.col("v.tf").alias("tfs"), F.col("v.first").alias("firsts"))
    return rows.join(again, same, "left_anti").unionByName(whole)


def unpacked_counts(rows: DataFrame) -> DataFrame:
    """(id, term, tf, first) of rows (id, terms, tfs, firsts)."""
    each = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("firsts").alias("first")))
    return rows.select("id", each.alias("x")).select("id", "x.term", "x.tf", "x.first")


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf, first): occurrences of each term in each text, and its first place.

    Null texts have no terms. Counted before anything is shuffled.
    """
    return unpacked_counts(counted_rows(docs, id_col, text_col))


def _per_term(terms: pa.Array, n: np.ndarray, df: np.ndarray | None, ids: pa.Array, first: pa.Array) -> pa.RecordBatch:
    """A row for each distinct term of entries that stand in order of (id, first); df: none where each entry is a text's."""
    coded = terms.dictionary_encode()
    code, width = coded.indices.to_numpy(), len(coded.dictionary)
    at = np.empty(width, np.int64)
    at[code[::-1]] = np.arange(len(code))[::-1]  # of entries of one term the first is written last
    total = lambda x: pa.array(np.bincount(code, x, width).astype(np.int64))
    return pa.RecordBatch.from_arrays([coded.dictionary, total(n), total(df), ids.take(pa.array(at)), first.take(pa.array(at))], ["term", "n", "df", "id", "first"])


def _of_rows(rows: pa.RecordBatch) -> pa.RecordBatch:
    rows = rows.take(pc.array_sort_indices(rows.column("id"), null_placement="at_start"))
    ids = rows.column("id").take(pa.array(np.repeat(np.arange(rows.num_rows), rows.column("terms").value_lengths().to_numpy())))
    return _per_term(rows.column("terms").flatten(), rows.column("tfs").flatten().to_numpy(), None, ids, rows.column("firsts").flatten())


def _of_sums(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks()
    whole = whole.take(pc.sort_indices(whole, [("id", "ascending"), ("first", "ascending")], null_placement="at_start")).combine_chunks().to_batches()[0]
    return _per_term(whole.column("term"), whole.column("n").to_numpy(), whole.column("df").to_numpy(), whole.column("id"), whole.column("first"))


def _summed(most: int):
    """Counted rows as sums (term, n, df, id, first): a row for each term of a task, or of a stretch of it whose terms take over half of most bytes."""

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for low, high in _slices(batch.column("terms").value_lengths().to_numpy(), COUNTED):
                part = _of_rows(batch.slice(low, high - low))
                if not part.num_rows:
                    continue
                parts.append(part)
                held += part.nbytes
                if held > most:
                    parts = [_of_sums(parts)]
                    held = parts[0].nbytes
                    if held > most // 2:
                        yield parts[0]
                        parts, held = [], 0
        if parts:
            yield _of_sums(parts)

    return run


def summed_counts(rows: DataFrame, most: int = SUMMED) -> DataFrame:
    """(term, n, df, id, first): what each task's counted rows add to a term's frequencies, and where they have it first.

    Summed before Spark sees a term, so that what it sorts, spills and shuffles are a
    task's distinct terms and not all terms of all texts.
    """
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_summed(most), f"term string, n bigint, df bigint, id {kind}, first int")


def frequencies(counts: DataFrame) -> DataFrame:
    """(term, n, df, seen): corpus frequency, document frequency, first (id, place) of each term, of counted rows or of counts (id, term, tf, first)."""
    some = summed_counts(counts) if "terms" in counts.columns else counts.select("term", F.col("tf").alias("n"), F.lit(1).cast("long").alias("df"), "id", "first")
    return some.groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"), F.min(F.struct("id", "first")).alias("seen"))


def vocabulary(counts: DataFrame, n_docs: int, most: int = 50_000) -> DataFrame:
    """(term, index, idf) of the most frequent terms of counts as frequencies() takes them, ties by first occurrence; idf = ln(N / df) + 1 to six places.

    The limit comes before the numbering, so one task numbers most rows at most.
    """
    order = [F.col("n").desc(), F.col("seen")]
    top = frequencies(counts).orderBy(*order).limit(most)
    index = F.row_number().over(Window.orderBy(*order)) - 1
    return top.select("term", index.alias("index"), F.round(F.log(F.lit(float(n_docs)) / F.col("df")) + 1, 6).alias("idf"))


def encode_sparse(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, index, weight) with weight tf * idf; terms outside the vocabulary are left out."""
    return counts.join(vocab, "term").select("id", "index", (F.col("tf") * F.col("idf")).alias("weight"))


def sparse_top_k(queries: DataFrame, docs: DataFrame, k: int = 20) -> DataFrame:
    """(query, id, score, rank): largest inner products of sparse vectors (id, index, weight), ties (to six places) by id.

    By an inverted index of impacts over parts of the documents (sparse_index); a
    query without known terms has no rows. Weights are positive; null ids take no part.
    """
    return ranked(sparse_index.top_rows(queries, docs, k), ["query"], [F.round("score", 6).desc(), F.col("id")], k)


def _known(names: pa.Array, index: np.ndarray, idf: np.ndarray):
    """Rows of counts as sparse vectors over some terms; rows without any of them go."""

    def run(batches):
        for batch in batches:
            for low, high in _slices(batch.column("terms").value_lengths().to_numpy(), COUNTED):
                ids, terms, tfs = (batch.column(c).slice(low, high - low) for c in ("id", "terms", "tfs"))
                size = terms.value_lengths().to_numpy()
                found = pc.fill_null(pc.index_in(terms.flatten(), value_set=names.value), -1).to_numpy()
                at = np.flatnonzero(found >= 0)
                row, term = np.repeat(np.arange(len(size)), size)[at], index.value[found[at]]
                order = np.lexsort((term, row))
                at, row = at[order], row[order]
                held, bounds = np.unique(row, return_index=True)
                bounds = np.append(bounds, len(row))
                weight = tfs.flatten().to_numpy()[at] * idf.value[found[at]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(held)), _list_of(bounds, pa.array(term[order])), _list_of(bounds, pa.array(weight))], ["id", "terms", "weights"])

    return run


def sparse_rows(counts: DataFrame, vocab: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, terms, weights): sparse vectors of counted rows over the terms that asked (id, index, weight) holds.

    A term that no query holds adds nothing to any score. The vocabulary's part is
    broadcast: it has a fixed number of rows at most.
    """
    some = vocab.join(asked.select("index").distinct(), "index", "left_semi").collect()
    context = counts.sparkSession.sparkContext
    values = (pa.array([x.term for x in some], pa.string()), np.array([x["index"] for x in some], np.int64), np.array([x.idf for x in some], np.float64))
    kind = counts.schema["id"].dataType.simpleString()
    return counts.mapInArrow(_known(*map(context.broadcast, values)), f"id {kind}, terms array<bigint>, weights array<double>")


def sparse_search(queries: DataFrame, counts: DataFrame, vocab: DataFrame, k: int = 20, among: DataFrame | None = None) -> DataFrame:
    """sparse_top_k of queries (id, text) over counted rows, or over counts (id, term, tf), whose vectors are made on the way; among: (id), the only ones to take."""
    asked = stored(encode_sparse(term_counts(queries, "id", "text"), vocab), "asked-terms")
    packed = "terms" in counts.columns
    docs = sparse_rows(counts, vocab, asked) if packed else encode_sparse(counts, vocab)
    docs = docs if among is None else docs.join(among, "id", "left_semi")
    return ranked(sparse_index.top_rows(asked, docs, k), ["query"], [F.round("score", 6).desc(), F.col("id")], k)


def ranked(rows: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """rows with rank from 1 within by, the first k of each (a column named rank is replaced); Spark drops what can't be among them before the shuffle."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def _packed(batches):
    for batch in batches:
        column = batch.column("embedding")
        width = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids, at = batch.column("id").to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(width)))
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            rows = flat[at[own][:, None] + np.arange(w)]
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
            for low in range(0, len(own), 2048):
                some = own[low : low + 2048]
                yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([rows[low : low + 2048].tobytes()], pa.binary())], ["width", "ids", "rows"])


def _nearest(k: int):
    def run(batches):
        for batch in batches:
            for w, ids, rows, q_ids, q_rows in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                score = np.round(np.frombuffer(q_rows, np.float64).reshape(-1, w) @ np.frombuffer(rows, np.float64).reshape(-1, w).T, 6)
                score[q_ids[:, None] == ids[None, :]] = -np.inf  # a vector isn't its own neighbour
                order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1)
                fine = best > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, order.shape[1]).reshape(order.shape)[fine]), pa.array(ids[order][fine]), pa.array(best[fine])], ["query", "id", "score"])

    return run


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """(query, id, score, rank): largest cosines between (id, embedding) rows, to six places, ties by id.

    Exact: blocks of queries meet blocks of vectors in one matrix product each;
    a block pair hands on k rows a query. A row isn't its own neighbour. Null
    ids and vectors are left out; vectors meet those of their own width.
    """
    fine = F.col("id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull())
    kind = "width int, ids binary, rows binary"
    pack = lambda df: df.where(fine).select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(_packed, kind)
    # Blocks of vectors are dealt out once; each block of queries visits every cell, so no task has all of a width.
    cells = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = pack(queries).select("width", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    found = pack(vectors).withColumn("cell", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int")).join(q, ["width", "cell"]).select("width", "ids", "rows", "q_ids", "q_rows").mapInArrow(_nearest(k), "query long, id long, score double")
    return ranked(found, ["query"], [F.col("score").desc(), F.col("id")], k)


def hash_encode(counts: DataFrame, width: int = 64) -> DataFrame:
    """(id, embedding): unit vectors of hashed term counts, a stand-in for a model's vectors where none are given.

    A term's place is its MD5 modulo width; terms that share one add up.
    """
    place = F.conv(F.left(F.md5("term"), F.lit(6)), 16, 10).cast("long") % width
    cells = counts.groupBy("id", place.alias("place")).agg(F.sum("tf").alias("v"))
    rows = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long")), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)) / F.col("norm"))
    return rows.select("id", vector.alias("embedding"))
