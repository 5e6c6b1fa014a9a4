"""The retrieval operators as queries over a folder of tables, each with the SQL that must agree.

``documents`` are the corpus, ``benchmark`` the questions, ``embeddings`` the dense
vectors (vec_id as doc_id), ``pages`` raw HTML, ``conversations`` families of turns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions import metadata, text
from loreweave.operators import chunking, context, evaluation, graph, quantiser, ranking, routing, store, vectors
from loreweave.plans import retrieval
from loreweave.sources import help as help_files
from loreweave.sources import html
from loreweave.sources.shared import stored
from loreweave.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared inputs, in Spark and in SQL

TOKENS_SQL = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:[_.\-][a-z0-9]+)*|[\x{{4e00}}-\x{{9fff}}]')"
COUNTS_SQL = f"""
dw AS (SELECT doc_id AS id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {TOKENS_SQL.format("text")} AS t FROM documents)),
dc AS (SELECT id, term, count(*) AS tf, min(pos) AS first FROM dw GROUP BY ALL),
fr AS (SELECT term, sum(tf)::BIGINT AS n, count(*) AS df, min(struct_pack(id := id, f := first)) AS seen FROM dc GROUP BY term),
vo AS (SELECT term, n, df, (row_number() OVER (ORDER BY n DESC, seen) - 1)::INTEGER AS index, round(ln((SELECT count(*) FROM documents)::DOUBLE / df) + 1, 6) AS idf FROM fr QUALIFY index < 50000),
en AS (SELECT id, index, tf * idf AS weight FROM dc JOIN vo USING (term))
"""
SEARCH_SQL = f"""
qw AS (SELECT item_id AS query, unnest({TOKENS_SQL.format("text")}) AS term FROM benchmark),
qe AS (SELECT query, index, count(*) * any_value(idf) AS q FROM qw JOIN vo USING (term) GROUP BY query, index),
sc AS (SELECT query, id, sum(q * weight) AS score FROM qe JOIN en USING (index) GROUP BY query, id),
sp AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id)::INTEGER AS rank FROM sc QUALIFY rank <= 20)
"""


def _corpus(spark, sf_dir):
    """Term counts of the corpus, tokenised once, and its vocabulary."""
    return retrieval.Corpus.of(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _counted(spark, sf_dir):
    """Term counts of the corpus, tokenised once, a row for each document."""
    return stored(vectors.counted_rows(table(spark, sf_dir, "documents"), "doc_id", "text"), "term-counts")


def _counts(spark, sf_dir):
    """Term counts of the corpus, tokenised once."""
    return vectors.unpacked_counts(_counted(spark, sf_dir))


def _search(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return vectors.sparse_search(asked, corpus.counts, corpus.vocab)


def _hits(spark, sf_dir):
    """(query, query_text, id, text, source, lang, pos, score): the sparse search with its documents, searched once."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))
    found = stored(_search(spark, sf_dir).withColumnRenamed("rank", "pos"), "hits")
    return stored(found.join(docs, "id").join(asked, "query"), "hit-texts")


HITS_SQL = f"""WITH {COUNTS_SQL}, {SEARCH_SQL},
hi AS (SELECT query, b.text AS query_text, id, d.text, d.source, d.lang, rank AS pos, score FROM sp JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query)
"""

# --- vectors


@query(f"WITH {COUNTS_SQL} SELECT term, n, df FROM fr")
def tokenize_counts(spark, sf_dir):
    return vectors.frequencies(_counted(spark, sf_dir)).select("term", "n", "df")


@query(f"WITH {COUNTS_SQL} SELECT term, index, idf FROM vo")
def sparse_vocab_topn(spark, sf_dir):
    return vectors.vocabulary(_counted(spark, sf_dir), table(spark, sf_dir, "documents").count())


@query(f"WITH {COUNTS_SQL} SELECT id AS doc_id, index, round(weight, 6) AS weight FROM en")
def sparse_encode(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    out = vectors.encode_sparse(vectors.unpacked_counts(corpus.counts), corpus.vocab)
    return out.select(F.col("id").alias("doc_id"), "index", F.round("weight", 6).alias("weight"))


@query(f"WITH {COUNTS_SQL}, {SEARCH_SQL} SELECT query, id, round(score, 4) AS score, rank FROM sp")
def sparse_search_topk(spark, sf_dir):
    return _search(spark, sf_dir).select("query", "id", F.round("score", 4).alias("score"), "rank")


DENSE_SQL = """
v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT q.id AS query, v.id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) AS score FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id{})
"""


@query(f"WITH {DENSE_SQL.format('')} SELECT query, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= 20")
def dense_search_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 asks for its 20 nearest."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.dense_top_k(v.where("id % 20 = 0"), v).withColumn("score", F.round("score", 4))


@query(f"WITH {DENSE_SQL.format(' AND v.label IN (1, 3, 5)')} SELECT query, id, round(score, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= 10")
def dense_search_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    v = rows.select(F.col("vec_id").alias("id"), "embedding")
    some = rows.where(store.predicate({"label": [1, 3, 5]})).select(F.col("vec_id").alias("id"), "embedding")
    return vectors.dense_top_k(v.where("id % 20 = 0"), some, 10).withColumn("score", F.round("score", 4))


def _approximate(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return quantiser.search(v.where("id % 20 = 0"), v, quantiser.fit(v))


@query()
def dense_search_approximate(spark, sf_dir):
    """dense_search_topk by cells; a test holds its scores and its recall against the exact rows."""
    return _approximate(spark, sf_dir)


@query(f"""WITH {DENSE_SQL.format('')}, e AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM c QUALIFY rank <= 20) SELECT count(*) AS n, true AS enough FROM e""")
def approximate_recall(spark, sf_dir):
    """How many exact neighbours there are, and whether nine in ten are found by cells."""
    out = quantiser.recall_of(_approximate(spark, sf_dir), dense_search_topk(spark, sf_dir))
    return out.select("n", (F.col("recall") >= 0.9).alias("enough"))


# --- fusion and boosts

BM25_TAIL = r""",
w AS (SELECT query, id, unnest(string_split_regex(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS word FROM hi),
tf AS (SELECT query, id, word, count(*) AS tf FROM w WHERE word <> '' GROUP BY ALL),
dl AS (SELECT query, id, sum(tf) AS size FROM tf GROUP BY ALL),
st AS (SELECT query, count(*) AS n, sum(coalesce(size, 0))::DOUBLE / count(*) AS mean FROM hi LEFT JOIN dl USING (query, id) GROUP BY query),
df AS (SELECT query, word, count(*) AS df FROM tf GROUP BY ALL),
i0 AS (SELECT query, word, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN st USING (query)),
i1 AS (SELECT query, word, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY query) ELSE raw END AS idf FROM i0),
qq AS (SELECT item_id AS query, unnest(string_split_regex(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) AS word FROM benchmark),
qt AS (SELECT query, word, count(*) AS times FROM qq WHERE word <> '' GROUP BY ALL),
bs AS (SELECT query, id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN qt USING (query, word) JOIN i1 USING (query, word) JOIN dl USING (query, id) JOIN st USING (query) GROUP BY query, id),
bm AS (SELECT hi.query, hi.id, hi.pos, round(coalesce(bs.score, 0), 6) AS score FROM hi LEFT JOIN bs USING (query, id)),
br AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos)::INTEGER AS rank FROM bm)
"""


BM25_SQL = HITS_SQL + BM25_TAIL


@query(BM25_SQL + "SELECT query, id, round(score, 4) AS score FROM br")
def bm25_rerank(spark, sf_dir):
    return ranking.bm25(_hits(spark, sf_dir)).select("query", "id", F.round("score", 4).alias("score"))


FUSED_SQL = f"""WITH {COUNTS_SQL}, {SEARCH_SQL}, {DENSE_SQL.format(' AND q.id IN (SELECT item_id FROM benchmark)').replace('q.id % 20 = 0', 'true')},
de AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id)::INTEGER AS rank FROM c QUALIFY rank <= 20),
fu AS (SELECT coalesce(de.query, sp.query) AS query, coalesce(de.id, sp.id) AS id, de.rank AS one, sp.rank AS two,
       round(coalesce(0.7::DOUBLE / (60 + de.rank), 0) + coalesce(0.3::DOUBLE / (60 + sp.rank), 0), 9) AS score FROM de FULL JOIN sp ON de.query = sp.query AND de.id = sp.id),
fr2 AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, one NULLS LAST, two NULLS LAST)::INTEGER AS rank FROM fu)
"""


def _dense(spark, sf_dir):
    """The dense neighbours of each question's vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "id", "left_semi")
    return vectors.dense_top_k(asked, v)


@query(FUSED_SQL + ", hi AS (SELECT de.query, b.text AS query_text, de.id, d.text, d.source, de.rank AS pos FROM de JOIN documents d ON d.doc_id = de.id JOIN benchmark b ON b.item_id = de.query)" + BM25_TAIL + "SELECT query, id, round(score, 4) AS score, rank FROM br")
def bm25_dense(spark, sf_dir):
    """Dense candidates put in order by their words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))
    rows = stored(_dense(spark, sf_dir).select("query", "id", F.col("rank").alias("pos")).join(docs, "id").join(asked, "query"), "dense-texts")
    return ranking.bm25(rows).select("query", "id", F.round("score", 4).alias("score"), "rank")


def _fused(spark, sf_dir):
    return ranking.fuse(_dense(spark, sf_dir), _search(spark, sf_dir))


@query(FUSED_SQL + "SELECT query, id, score, rank FROM fr2")
def hybrid_rrf(spark, sf_dir):
    """Dense neighbours of a question's vector and sparse hits of its text, fused by reciprocal rank."""
    return _fused(spark, sf_dir)


TITLE_SQL = HITS_SQL + r""",
qt AS (SELECT item_id AS query, list_distinct(list_filter(string_split(lower(split_part(text, chr(10), 1)), ' '), lambda x: len(x) > 3)) AS terms FROM benchmark),
ti AS (SELECT hi.*, list_sum(list_transform(terms, lambda t: contains(lower(split_part(text, chr(10), 1)), t)::INTEGER))::INTEGER AS m, len(terms) AS n FROM hi JOIN qt USING (query)),
bo AS (SELECT query, id, pos, coalesce(m, 0) AS matches, n, score, score * (1 + 0.15::DOUBLE * coalesce(m, 0)) AS boosted FROM ti)
"""


def _terms(column="query_text"):
    """Words of over three characters of a question's first line, as title terms."""
    return F.array_distinct(F.filter(F.split(F.lower(text.title(column)), " "), lambda x: F.length(x) > 3))


@query(TITLE_SQL + "SELECT query, id, matches::INTEGER AS matches, round(boosted, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN n > 0 THEN round(boosted, 6) END DESC, pos)::INTEGER AS rank FROM bo")
def title_boost(spark, sf_dir):
    out = ranking.boost_titles(_hits(spark, sf_dir), text.title("text"), _terms())
    return out.select("query", "id", F.col("matches").cast("int").alias("matches"), F.round("score", 4).alias("score"), "rank")


@query(TITLE_SQL + """,
ch AS (SELECT query, id, 1 AS part, pos AS place FROM bo WHERE pos <= 10),
fi AS (SELECT query, id, 0 AS part, row_number() OVER (PARTITION BY query ORDER BY matches DESC, round(score, 6) DESC, pos) AS place FROM bo WHERE matches > 0 QUALIFY place <= 3),
un AS (SELECT query, id, min(struct_pack(part := part, place := place)) AS met FROM (SELECT * FROM ch UNION ALL SELECT * FROM fi) GROUP BY query, id)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY met)::INTEGER AS rank FROM un""")  # fmt: skip
def title_preserve(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return ranking.keep_title_matches(hits.where("pos <= 10"), hits, text.title("text"), _terms())


SHAPE_SQL = HITS_SQL + r""",
qt AS (SELECT item_id AS query, list_distinct(list_filter(string_split(lower(split_part(text, chr(10), 1)), ' '), lambda x: len(x) > 3)) AS terms FROM benchmark),
r0 AS (SELECT hi.*, coalesce(list_sum(list_transform(terms, lambda t: contains(lower(split_part(text, chr(10), 1)), t)::INTEGER)), 0) > 1 AS tm,
       CASE WHEN pos <= 5 THEN 0 ELSE 1 END AS seed, CASE id % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END AS ko FROM hi JOIN qt USING (query)),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY seed, ko, NOT tm, pos) AS k FROM r0),
r2 AS (SELECT *, tm AND row_number() OVER (PARTITION BY query, source, tm ORDER BY k) <= 2 AS able FROM r1),
r3 AS (SELECT *, able AND sum(able::INTEGER) OVER (PARTITION BY query ORDER BY k) <= 3 AS early FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY early DESC, k) AS ins FROM r3 QUALIFY ins <= 2),
r5 AS (SELECT *, CASE WHEN early THEN 0 WHEN NOT bool_or(early) OVER (PARTITION BY query, source) AND ins = 1 THEN 1 ELSE 2 END AS phase FROM r4)
SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY phase, k)::INTEGER AS rank FROM r5 QUALIFY rank <= 12
"""


@query(SHAPE_SQL)
def rerank_shape(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("section"), F.lit("paragraph"), F.lit("document")), (F.col("id") % 3 + 1).cast("int"))
    rows = _hits(spark, sf_dir).withColumns({"kind": kind, "title_match": text.match_count(text.title("text"), _terms()) > 1})
    return ranking.shape_rerank_input(rows, seeds=5, most=12).select("query", "id", "rank")


@query(HITS_SQL + "SELECT query, id, left(lang || ' > ' || source || ' | ' || split_part(text, chr(10), 1) || chr(10) || text, 2400) AS body FROM hi")
def rerank_text(spark, sf_dir):
    body = ranking.rerank_text(F.col("text"), F.array("lang", "source"), text.title("text"), F.lit(""))
    return _hits(spark, sf_dir).select("query", "id", body.alias("body"))


@query(HITS_SQL + r""",
s AS (SELECT query, id, pos, list_distinct(list_filter(string_split_regex(lower(query_text), '\s+'), lambda x: x <> '')) AS a, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS b FROM hi),
t AS (SELECT query, id, pos, round(len(list_intersect(a, b))::DOUBLE / greatest(len(a), 1), 6) AS score FROM s)
SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, pos)::INTEGER AS rank FROM t QUALIFY rank <= 5""")  # fmt: skip
def rerank_lexical(spark, sf_dir):
    """The reranker's place, filled by a deterministic lexical score."""
    hits = _hits(spark, sf_dir).withColumn("score", ranking.lexical_score(F.col("query_text"), F.col("text")))
    return vectors.ranked(hits, ["query"], [F.col("score").desc(), F.col("pos")], 5).select("query", "id", "score", "rank")


@query(HITS_SQL + """,
m AS (SELECT query, max(score) AS top FROM hi GROUP BY query), n AS (SELECT hi.query, pos, score / top AS s FROM hi JOIN m USING (query)),
a AS (SELECT query, max(s) FILTER (WHERE pos = 1) AS one, max(s) FILTER (WHERE pos = 3) AS three, count(*) AS n FROM n GROUP BY query)
SELECT query, CASE WHEN one > 0.8 AND n >= 3 AND one - three > 0.2 THEN 'high' WHEN one > 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM a""")  # fmt: skip
def confidence(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    top = hits.groupBy("query").agg(F.max("score").alias("top"))
    return ranking.confidence(hits.join(top, "query").select("query", (F.col("score") / F.col("top")).alias("score"), F.col("pos").alias("rank")))


# --- chunking

HEADS_SQL = """
ln AS (SELECT doc_id AS id, unnest(range(len(l)))::INTEGER AS pos, unnest(l) AS line, len(l) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
hd AS (SELECT id, pos, (1 + (length(line) + pos) % 4)::INTEGER AS level, n FROM ln WHERE pos % 2 = 0),
bd AS (SELECT *, coalesce(lead(pos) OVER (PARTITION BY id ORDER BY pos) - 1, n - 1)::INTEGER AS end_line FROM hd)
"""


def _lines(spark, sf_dir):
    return chunking.lines(table(spark, sf_dir, "documents"), "doc_id", "text")


def _heads(spark, sf_dir):
    """Every other line as a heading whose level comes from its length, since the corpus has no marks."""
    marks = F.repeat(F.lit("#"), (1 + (F.length("line") + F.col("pos")) % 4).cast("int"))
    marked = _lines(spark, sf_dir).where("pos % 2 = 0").withColumn("line", F.concat(marks, F.lit(" x"), "line"))
    return chunking.headings(marked).drop("title")


@query(f"WITH {HEADS_SQL} SELECT id, pos, length(line)::INTEGER AS size FROM ln")
def line_positions(spark, sf_dir):
    return _lines(spark, sf_dir).select("id", "pos", F.length("line").alias("size"))


@query(f"WITH {HEADS_SQL} SELECT id, pos, level, pos AS start_line, end_line FROM bd")
def section_bounds(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(F.split("text", "\n")).alias("n_lines"))
    return chunking.section_bounds(_heads(spark, sf_dir), sizes)


PARENT_SQL = HEADS_SQL + """,
pa AS (SELECT id, pos, level, coalesce(
  CASE WHEN level > 3 THEN last_value(CASE WHEN level = 3 THEN pos END IGNORE NULLS) OVER w END,
  CASE WHEN level > 2 THEN last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER w END,
  CASE WHEN level > 1 THEN last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER w END, -1)::INTEGER AS parent
  FROM hd WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
"""


@query(f"WITH {PARENT_SQL} SELECT id, pos, level, parent FROM pa")
def section_parent(spark, sf_dir):
    return chunking.parents(_heads(spark, sf_dir))


@query(f"WITH {PARENT_SQL} SELECT a.id, a.pos, a.parent, count(b.pos) AS n_siblings, coalesce(string_agg(b.pos::VARCHAR, ',' ORDER BY b.pos), '') AS siblings FROM pa a LEFT JOIN pa b ON a.id = b.id AND a.parent = b.parent AND a.pos <> b.pos GROUP BY ALL")
def siblings(spark, sf_dir):
    out = chunking.siblings(chunking.parents(_heads(spark, sf_dir)))
    return out.select("id", "pos", "parent", F.size("siblings").cast("long").alias("n_siblings"), F.array_join(F.transform("siblings", lambda x: x.cast("string")), ",").alias("siblings"))


@query(f"WITH {HEADS_SQL} SELECT ln.id, bd.pos AS section, ln.pos AS item FROM ln JOIN bd ON ln.id = bd.id AND ln.pos BETWEEN bd.pos AND bd.end_line WHERE length(line) % 5 = 0")
def item_in_section(spark, sf_dir):
    """Lines whose length is divisible by five stand in for code, tables and images."""
    items = _lines(spark, sf_dir).where(F.length("line") % 5 == 0).select("id", F.col("pos").alias("item_line"))
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(F.split("text", "\n")).alias("n_lines"))
    return chunking.items_in_sections(items, chunking.section_bounds(_heads(spark, sf_dir), sizes))


@query("SELECT doc_id, (unnest(range(len(p))))::INTEGER AS pos, unnest(p) AS paragraph FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents WHERE length(replace(text, chr(10), chr(10) || chr(10))) > 800)")
def paragraph_split(spark, sf_dir):
    """With line feeds doubled, so that each line is a paragraph."""
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.paragraphs(body)).alias("pos", "paragraph"))


@query("""
WITH b AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS c FROM documents), h AS (SELECT doc_id, c, left(c, 500) AS h FROM b),
a AS (SELECT *, 500 - instr(reverse(h), chr(10) || chr(10)) - 1 AS cut, instr(reverse(h), chr(10) || chr(10)) AS back FROM h)
SELECT doc_id, CASE WHEN length(c) <= 500 THEN c WHEN back > 0 AND cut > 400 THEN left(h, cut) ELSE h END AS body FROM a""")  # fmt: skip
def truncate_boundary(spark, sf_dir):
    body = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(body, 500).alias("body"))


@query("SELECT doc_id, left(sha256(source || '::' || split_part(text, chr(10), 1) || '::doc::' || left(text, 200)), 32) AS id FROM documents")
def chunk_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.chunk_id(F.col("source"), text.title("text"), F.lit("doc"), F.col("text")).alias("id"))


def _found_sql(name: str, pattern: str, groups: int) -> str:
    """Matches of a pattern in mk's texts, with the lines where they start and end."""
    every = ", ".join(f"regexp_extract_all(text, '{pattern}', {i}) AS g{i}" for i in range(groups + 1))
    feeds = "length({0}) - length(replace({0}, chr(10), ''))"
    return f"""{name}0 AS (SELECT doc_id, {every}, string_split_regex(text, '{pattern}') AS gp FROM mk),
{name}1 AS (SELECT doc_id, unnest(range(len(g0)))::INTEGER AS nth, {", ".join(f"unnest(g{i}) AS g{i}" for i in range(groups + 1))}, unnest(gp[:len(g0)]) AS gap FROM {name}0),
{name} AS (SELECT *, (sum({feeds.format("gap")} + {feeds.format("g0")}) OVER (PARTITION BY doc_id ORDER BY nth))::INTEGER AS until, (until - ({feeds.format("g0")}))::INTEGER AS first FROM {name}1)"""


def _cut_sql(content: str, most: int) -> str:
    back = f"instr(reverse(left({content}, {most})), chr(10) || chr(10))"
    return f"CASE WHEN length({content}) <= {most} THEN {content} WHEN {back} > 0 AND {most} - {back} - 1 > 0.8 * {most} THEN left({content}, {most} - {back} - 1) ELSE left({content}, {most}) END"


_WHITE = f"'{chunking.WHITE}'"
_ROWS_SQL = f"list_filter(list_transform(string_split_regex(trim(g0, {_WHITE}), '{chunking.LINE_END}'), lambda x: trim(x, {_WHITE})), lambda x: x <> '')"
_CELLS_SQL = f"array_to_string(list_filter(list_transform(string_split({{}}, '|'), lambda c: trim(c, {_WHITE})), lambda c: c <> ''), ' | ')"
#: Lines of documents, by their lengths, as headings, images, fenced code, tables and blank lines.
MARKED_SQL = """
ml AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM documents),
mk AS (SELECT doc_id, array_to_string(list_transform(l, lambda x, i: CASE
  WHEN length(x) % 5 = 0 AND trim(x, ' ') <> '' THEN repeat('#', ((i - 1) % 4 + 1)::INTEGER) || ' ' || x
  WHEN length(x) % 7 = 1 THEN '![' || left(x, 10) || '](' || length(x) || '.png)'
  WHEN length(x) % 7 = 2 THEN '```py' || chr(10) || x || chr(10) || '```'
  WHEN length(x) % 7 = 3 THEN '| a | ' || replace(x, '|', '/') || ' |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || length(x) || ' | x |'
  WHEN length(x) % 11 = 4 THEN '' ELSE x END), chr(10)) AS text FROM ml)
"""
CHUNKS_SQL = f"""WITH {MARKED_SQL}, {_found_sql("hx", chunking.HEADINGS, 2)}, {_found_sql("co", chunking.CODE, 2)}, {_found_sql("ta", chunking.TABLE, 0)}, {_found_sql("im", chunking.IMAGE, 2)},
ln AS (SELECT doc_id, text, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS l FROM (SELECT doc_id, text, string_split_regex(text, '{chunking.LINE_END}') AS x FROM mk)),
dc AS (SELECT doc_id, doc_id::VARCHAR AS src, text, l, len(l)::INTEGER AS n, left(sha256(doc_id || '::T::doc::' || left(text, 200)), 32) AS id FROM ln),
s0 AS (SELECT doc_id, first AS start, coalesce(lead(first) OVER (PARTITION BY doc_id ORDER BY first) - 1, n - 1)::INTEGER AS "end", length(g1)::INTEGER AS level, trim(g2, {_WHITE}) AS name, l FROM hx JOIN dc USING (doc_id)),
s1 AS (SELECT doc_id, start, "end", level, name, coalesce(array_to_string(l[start + 2 : "end" + 1], chr(10)), '') AS body FROM s0
       UNION ALL SELECT doc_id, 0, n - 1, 1, '', text FROM dc WHERE doc_id NOT IN (SELECT doc_id FROM hx)),
s2 AS (SELECT *, left(sha256(doc_id || '::' || name || '::h' || level || '::' || left(body, 200)), 32) AS id, row_number() OVER (PARTITION BY doc_id ORDER BY start)::INTEGER AS sec FROM s1),
s3 AS (SELECT s2.*, coalesce(
    CASE WHEN level > 3 THEN last_value(CASE WHEN level = 3 THEN struct_pack(id := s2.id, sec := sec) END IGNORE NULLS) OVER w END,
    CASE WHEN level > 2 THEN last_value(CASE WHEN level = 2 THEN struct_pack(id := s2.id, sec := sec) END IGNORE NULLS) OVER w END,
    CASE WHEN level > 1 THEN last_value(CASE WHEN level = 1 THEN struct_pack(id := s2.id, sec := sec) END IGNORE NULLS) OVER w END, struct_pack(id := dc.id, sec := 0)) AS parent,
    CASE WHEN level <= 2 THEN name ELSE '' END AS st, CASE WHEN level <= 2 THEN '' ELSE name END AS sst
  FROM s2 JOIN dc USING (doc_id) WINDOW w AS (PARTITION BY s2.doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p0 AS (SELECT *, list_filter(list_transform(string_split_regex(body, '\n[{chunking.SPACE}]*\n'), lambda x: trim(x, {_WHITE})), lambda x: x <> '') AS ps FROM s3 WHERE length(body) > 800),
p1 AS (SELECT * EXCLUDE (ps), unnest(ps) AS content, unnest(range(len(ps)))::INTEGER AS nth FROM p0),
tr AS (SELECT *, {_ROWS_SQL} AS r FROM ta),
me AS (SELECT doc_id, 'code_block' AS kind, 2 AS part, 'code' AS suffix, nth, first, until, g2 AS content, left(g2, 200) AS key FROM co
       UNION ALL SELECT doc_id, 'table', 3, 'table', nth, first, until, 'Table:' || chr(10) || {_CELLS_SQL.format("r[1]")} || chr(10) || coalesce(array_to_string(list_transform(r[3:], lambda y: {_CELLS_SQL.format("y")}), chr(10)), ''), left(g0, 200) FROM tr
       UNION ALL SELECT doc_id, 'image', 4, 'img', nth, first, until, 'Image: ' || g1 || ' (' || g2 || ')', g2 FROM im),
al AS (
  SELECT doc_id, 0 AS sec, 0 AS part, 0 AS nth, 'document' AS kind, '' AS st, '' AS sst, 0 AS level, 0 AS start_line, 0 AS end_line, {_cut_sql("text", 8000)} AS content, id, NULL AS parent, ['T'] AS path FROM dc
  UNION ALL SELECT doc_id, sec, 0, 0, CASE WHEN level <= 2 THEN 'section' ELSE 'subsection' END, st, sst, level, start, "end", CASE WHEN level <= 2 THEN {_cut_sql("c", 4000)} ELSE {_cut_sql("c", 2000)} END, id, parent, ['T', name]
    FROM (SELECT *, trim(name || chr(10) || chr(10) || body, {_WHITE}) AS c FROM s3)
  UNION ALL SELECT doc_id, sec, 1, nth, 'paragraph', st, sst, level, start, "end", content, left(sha256(doc_id || '::' || name || '::para-' || nth || '::' || content), 32), struct_pack(id := id, sec := sec), ['T', name] FROM p1
  UNION ALL SELECT me.doc_id, sec, part, nth, kind, st, sst, level, first, until, content, left(sha256(me.doc_id || '::' || st || '::' || suffix || '::' || key), 32), struct_pack(id := s3.id, sec := sec), ['T', name] FROM me JOIN s3 ON s3.doc_id = me.doc_id AND first BETWEEN start AND "end"),
po AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, part, nth) - 1)::INTEGER AS pos FROM al),
ch AS (SELECT doc_id, parent.sec AS sec, string_agg(id, ',' ORDER BY pos) AS ids FROM po WHERE parent IS NOT NULL GROUP BY ALL),
fa AS (SELECT doc_id, parent.id AS pid, list(id ORDER BY pos) AS ids FROM po WHERE parent IS NOT NULL GROUP BY ALL)
SELECT po.doc_id::VARCHAR AS source_md, 'T' AS doc_title, pos, po.id, kind AS chunk_type, st AS section_title, sst AS subsection_title, level AS heading_level, start_line, end_line, content, po.parent.id AS parent_id,
  CASE WHEN part = 0 THEN coalesce(ch.ids, '') ELSE '' END AS child_ids, coalesce(array_to_string(list_filter(fa.ids, lambda x: x <> po.id), ','), '') AS sibling_ids, array_to_string(path, '|') AS toc_path
FROM po LEFT JOIN ch ON ch.doc_id = po.doc_id AND ch.sec = po.sec LEFT JOIN fa ON fa.doc_id = po.doc_id AND fa.pid = po.parent.id
"""


@query(CHUNKS_SQL)
def hierarchical_chunks(spark, sf_dir):
    """The whole chunker over documents some of whose lines are made headings, images, code, tables and blank lines."""
    lines = F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n", -1)

    def marked(x, i):
        n = F.length(x)
        put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        table_ = put("| a | ", F.replace(x, F.lit("|"), F.lit("/")), " |\n|---|:-:|\n| ", n.cast("string"), " | x |")
        out = F.when((n % 5 == 0) & (F.trim(x) != ""), put(F.repeat(F.lit("#"), i % 4 + 1), " ", x)).when(n % 7 == 1, put("![", F.left(x, F.lit(10)), "](", n.cast("string"), ".png)"))
        return out.when(n % 7 == 2, put("```py\n", x, "\n```")).when(n % 7 == 3, table_).when(n % 11 == 4, "").otherwise(x)

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("T").alias("title"), F.array_join(F.transform(lines, marked), "\n").alias("text"))
    out = chunking.chunk_documents(docs, "source", "title", "text")
    return out.withColumns({c: F.array_join(c, "|" if c == "toc_path" else ",") for c in ("child_ids", "sibling_ids", "toc_path")})


@query()
def page_chunks(spark, sf_dir):
    """Pages as Markdown, then the whole chunker."""
    pages = table(spark, sf_dir, "pages").select("url", html.page_title(F.col("html")).alias("title"), html.markdown(F.col("html"), html.page_title(F.col("html"))).alias("text"))
    return chunking.chunk_documents(pages, "url", "title", "text")


@query()
def html_to_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.tidy(html.markdown(F.col("html"))).alias("markdown"))


@query(r"""
WITH h AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: regexp_replace(x, '[?#].*$', '')), lambda x: x <> '') AS l FROM pages),
u AS (SELECT page_id, unnest(l) AS href, unnest(range(len(l))) AS i FROM h)
SELECT page_id, href, (row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1)::INTEGER AS pos FROM u GROUP BY page_id, href""")  # fmt: skip
def extract_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.hrefs("html")).alias("pos", "href"))


# --- link graph: parts bought one after the other in an order

EDGES_SQL = """
it AS (SELECT l_orderkey, l_linenumber, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem),
ed AS (SELECT src, dst, min(l_orderkey * 8 + l_linenumber) AS pos FROM it WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
nb AS (SELECT src, dst, min(struct_pack(way := way, place := place, dst := dst)) AS met FROM (SELECT src, dst, 0 AS way, pos AS place FROM ed UNION ALL SELECT dst, src, 1, 0 FROM ed) GROUP BY src, dst),
ne AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY met)::INTEGER AS nth FROM nb QUALIFY nth <= 5)
"""


def _edges(spark, sf_dir):
    from pyspark.sql import Window

    lines_ = table(spark, sf_dir, "lineitem")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    pairs = lines_.select(F.col("l_partkey").alias("src"), after.alias("dst"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return pairs.where("dst is not null and src <> dst").groupBy("src", "dst").agg(F.min("pos").alias("pos"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, nth FROM ne")
def neighbors_capped(spark, sf_dir):
    return graph.neighbors(_edges(spark, sf_dir))


@query(f"""WITH {EDGES_SQL},
se AS (SELECT p_partkey // 20 AS query, p_partkey AS node, p_partkey AS nth FROM part WHERE p_partkey % 20 < 2),
o1 AS (SELECT s.query, n.dst AS node, min(struct_pack(nth := n.nth, turn := s.nth)) AS met FROM se s JOIN ne n ON n.src = s.node GROUP BY s.query, n.dst),
h1 AS (SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY met) AS nth FROM o1 WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.query = o1.query AND se.node = o1.node)),
f1 AS (SELECT * FROM h1 WHERE nth <= 20),
o2 AS (SELECT s.query, n.dst AS node, min(struct_pack(nth := n.nth, turn := s.nth)) AS met FROM f1 s JOIN ne n ON n.src = s.node GROUP BY s.query, n.dst),
h2 AS (SELECT query, node, row_number() OVER (PARTITION BY query ORDER BY met) AS nth FROM o2 WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.query = o2.query AND se.node = o2.node) AND NOT EXISTS (SELECT 1 FROM f1 WHERE f1.query = o2.query AND f1.node = o2.node)),
f2 AS (SELECT h2.* FROM h2 LEFT JOIN (SELECT query, count(*) AS u FROM f1 GROUP BY query) USING (query) WHERE nth + coalesce(u, 0) <= 20)
SELECT query, node, 0 AS hop, nth FROM se UNION ALL SELECT query, node, 1, nth FROM f1 UNION ALL SELECT query, node, 2, nth FROM f2""")  # fmt: skip
def bfs_two_hop(spark, sf_dir):
    """From two parts of each twenty, two hops, twenty more at most."""
    seeds = table(spark, sf_dir, "part").where("p_partkey % 20 < 2").select(F.expr("p_partkey div 20").alias("query"), F.col("p_partkey").alias("node"), F.col("p_partkey").alias("nth"))
    return graph.expand(seeds, graph.neighbors(_edges(spark, sf_dir)))


@query(f"""WITH {EDGES_SQL},
fw AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY pos, dst) AS nth FROM ed) WHERE nth <= 5),
hu AS (SELECT DISTINCT p_size::BIGINT AS query, p_partkey AS node FROM part WHERE p_partkey % 7 = 0),
c1 AS (SELECT DISTINCT query, dst AS node FROM hu JOIN fw ON src = node EXCEPT SELECT query, node FROM hu),
al AS (SELECT query, node, 3 AS p FROM hu UNION ALL SELECT query, node, 2 FROM c1 UNION ALL SELECT query, dst, 1 FROM c1 JOIN fw ON src = node)
SELECT query, node, max(p)::INTEGER AS priority FROM al GROUP BY query, node""")  # fmt: skip
def hub_priority(spark, sf_dir):
    hubs = table(spark, sf_dir, "part").where("p_partkey % 7 = 0").select(F.col("p_size").cast("long").alias("query"), F.col("p_partkey").alias("node"))
    return graph.hub_priority(hubs, graph.neighbors(_edges(spark, sf_dir), reverse=False))


# --- dedup and quality


@query("SELECT left(sha256(text), 32) AS hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY ALL")
def dedup_content_hash(spark, sf_dir):
    key = F.left(F.sha2("text", 256), F.lit(32))
    return table(spark, sf_dir, "documents").groupBy(key.alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS rank FROM documents QUALIFY rank <= 3")
def dedup_per_source_cap(spark, sf_dir):
    return vectors.ranked(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], 3).select("source", "doc_id", "rank")


CANON_SQL = "WITH p AS (SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '_' || (doc_id % 5)::VARCHAR ELSE '' END || '.htm' AS path FROM documents), b AS (SELECT *, regexp_replace(path, '(?i)^(.+)_(\\d+)\\.html?$', '\\1.htm') AS base FROM p) SELECT b.doc_id, CASE WHEN base IN (SELECT path FROM p) THEN base ELSE path END AS canonical FROM b"


@query(CANON_SQL)
def dedup_canonical(spark, sf_dir):
    """Sources as page names, some with a variant's number."""
    variant = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_"), (F.col("doc_id") % 5).cast("string"))).otherwise("")
    pages = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", variant, F.lit(".htm")).alias("html_path"))
    return graph.canonical_pages(pages).select("doc_id", "canonical")


NORM_SQL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
LOW_SQL = f"""
q AS (SELECT doc_id, source, lang, text, {NORM_SQL} AS norm, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\\s+', ' ', 'g')) AS tn FROM documents),
lo AS (SELECT *, norm = '' OR starts_with(text, 'Image: ') OR tn IN ('functional changes', 'related information') OR (starts_with(norm, 'functional changes') AND length(norm) < 600)
  OR (length(norm) < 80 AND norm = tn) OR (length(norm) < 40 AND NOT regexp_matches(norm, '[.:;!?。；：]')) AS low FROM q)
"""


@query(f"WITH {LOW_SQL} SELECT doc_id, low FROM lo")
def low_utility(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_low_utility("text", F.lit("section"), [text.title("text")]).alias("low"))


@query(f"WITH {LOW_SQL} SELECT doc_id, round(CASE WHEN low THEN -1.0 ELSE 0.18 + least(length(text), 6000)::DOUBLE / 6000 * 0.12 + least((length(text) - length(replace(text, '](', ''))) // 2, 4) * 0.03 END, 6)::DOUBLE AS bonus FROM lo")
def quality_bonus(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(text.quality_bonus("text", F.lit("section"), [text.title("text")]), 6).alias("bonus"))


@query("SELECT source, CASE WHEN trim(split_part(text, chr(10), 1), ' ') <> '' THEN trim(split_part(text, chr(10), 1), ' ') ELSE source END AS topic, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY ALL")
def coverage_topics(spark, sf_dir):
    topic = text.coverage_topic(F.lit(""), text.title("text"), F.lit(""), F.col("source"))
    return table(spark, sf_dir, "documents").groupBy("source", topic.alias("topic")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


# --- context


def _hit_list(spark, sf_dir):
    return _hits(spark, sf_dir).withColumn("content", F.col("text"))


@query(HITS_SQL + """,
a AS (SELECT query, id, pos, text, length(text) // 4 AS own, sum(length(text) // 4) OVER (PARTITION BY query ORDER BY pos) AS upto FROM hi),
o AS (SELECT *, min(pos) FILTER (WHERE upto > 4000) OVER (PARTITION BY query) AS ov, 4000 - (upto - own) AS rest FROM a)
SELECT query, id, pos, (CASE WHEN pos = ov THEN least(length(text), rest * 4) // 4 ELSE own END)::BIGINT AS tokens FROM o WHERE ov IS NULL OR pos < ov OR (pos = ov AND rest > 100)""")  # fmt: skip
def compress_budget(spark, sf_dir):
    return context.compress(_hit_list(spark, sf_dir)).select("query", "id", "pos", "tokens")


ENTRY_SQL = """'[' || pos || '] From "' || split_part(text, chr(10), 1) || '" > "' || source || '":' || chr(10) || '    ' || trim(text, ' ') || chr(10)"""


def _entry():
    return F.concat(F.lit("["), F.col("pos").cast("string"), F.lit('] From "'), text.title("text"), F.lit('" > "'), F.col("source"), F.lit('":\n    '), F.trim("text"), F.lit("\n"))


@query(HITS_SQL + f""",
e AS (SELECT query, pos, {ENTRY_SQL} AS entry FROM hi), r AS (SELECT *, length(entry) // 4 AS own, sum(length(entry) // 4) OVER (PARTITION BY query ORDER BY pos) AS upto FROM e)
SELECT query, count(*) AS n, sum(own)::BIGINT AS token_estimate, sha256(string_agg(entry, chr(10) ORDER BY pos)) AS text_sha256 FROM r WHERE upto - own < 4000 GROUP BY query""")  # fmt: skip
def context_package(spark, sf_dir):
    out = context.package(_hits(spark, sf_dir), _entry())
    return out.select("query", "n", "token_estimate", F.sha2("text", 256).alias("text_sha256"))


@query(HITS_SQL + f""",
e AS (SELECT query, lang AS scope, pos, greatest(1, length({ENTRY_SQL}) // 4) AS own FROM hi), n AS (SELECT query, count(DISTINCT scope) AS s FROM e GROUP BY query),
r AS (SELECT e.*, sum(own) OVER (PARTITION BY query, scope ORDER BY pos) AS upto, 4000 // s AS budget FROM e JOIN n USING (query))
SELECT query, scope, count(*) AS n, sum(own)::BIGINT AS tokens FROM r WHERE upto <= budget GROUP BY query, scope""")  # fmt: skip
def scoped_context_package(spark, sf_dir):
    return context.scoped_package(_hits(spark, sf_dir).withColumn("scope", F.col("lang")), _entry())


@query("""WITH RECURSIVE r AS (SELECT conv_id AS query, turn AS pos, (length(text) < 400)::VARCHAR AS key, text AS content, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
f AS (SELECT query, i, key, [struct_pack(pos := pos, n := 1, content := content)] AS done FROM r WHERE i = 1
  UNION ALL SELECT r.query, r.i, r.key, CASE WHEN r.key = f.key AND length(done[-1].content) + length(r.content) < 3000
    THEN list_append(done[:-2], struct_pack(pos := done[-1].pos, n := done[-1].n + 1, content := done[-1].content || chr(10) || chr(10) || r.content)) ELSE list_append(done, struct_pack(pos := r.pos, n := 1, content := r.content)) END
  FROM f JOIN r ON r.query = f.query AND r.i = f.i + 1),
l AS (SELECT query, unnest(arg_max(done, i)) AS m FROM f GROUP BY query)
SELECT query, m.pos AS pos, m.n AS n, m.content AS content FROM l""")  # fmt: skip
def merge_adjacent(spark, sf_dir):
    """Turns of a conversation; neighbours of one length class merge."""
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select(F.col("conv_id").alias("query"), F.col("turn").alias("pos"), F.lit("").alias("source"), (F.length("text") < 400).cast("string").alias("section"), F.lit("turn").alias("kind"), F.col("text").alias("content"))
    return context.merge_adjacent(rows)


def _judged(spark, sf_dir):
    return _hit_list(spark, sf_dir).withColumns({"low": text.is_low_utility("text", F.lit("section"), [text.title("text")]), "topic": text.title("text")})


HIT_LOW_SQL = HITS_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
hn AS (SELECT *, {NORM_SQL} AS norm, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\\s+', ' ', 'g')) AS tn FROM hi),
hl AS (SELECT *, norm = '' OR starts_with(text, 'Image: ') OR tn IN ('functional changes', 'related information') OR (starts_with(norm, 'functional changes') AND length(norm) < 600)
  OR (length(norm) < 80 AND norm = tn) OR (length(norm) < 40 AND NOT regexp_matches(norm, '[.:;!?。；：]')) AS low FROM hn)
"""


def _fold_sql(name: str, rows: str, fields: str, fits: str) -> str:
    """Greedy selection over rows (query, i, id and fields): (query, id, rank) of those that fit what is in picked."""
    pack = ", ".join(f"{f} := r.{f}" for f in ["id", *fields.split()])
    return f"""{name} AS (SELECT query, 0::BIGINT AS i, [struct_pack({pack})][:0] AS picked FROM {rows} r WHERE i = 1
  UNION ALL SELECT r.query, r.i, CASE WHEN {fits} THEN list_append(picked, struct_pack({pack})) ELSE picked END FROM {name} g JOIN {rows} r ON r.query = g.query AND r.i = g.i + 1),
{name}_last AS (SELECT query, arg_max(picked, i) AS picked FROM {name} GROUP BY query),
{name}_rows AS (SELECT query, unnest(picked).id AS id, unnest(range(1, len(picked) + 1))::INTEGER AS rank FROM {name}_last)"""


def _has(what: str) -> str:
    return f"len(list_filter(picked, lambda p: {what})) > 0"


CONTEXT_FITS = f"NOT r.low AND len(picked) < 16 AND NOT {_has('p.id = r.id OR p.norm = r.norm OR (length(r.norm) > 120 AND contains(p.norm, r.norm))')} AND len(list_filter(picked, lambda p: p.source = r.source)) < 3 AND coalesce(list_sum(list_transform(picked, lambda p: p.tokens)), 0) + r.tokens <= 9000"


@query(HIT_LOW_SQL + f""", gr AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY pos, id) AS i, id, source, norm, low, greatest(1, length(text) // 4) AS tokens FROM hl),
{_fold_sql("fo", "gr", "source norm tokens", CONTEXT_FITS)} SELECT * FROM fo_rows""")
def greedy_context(spark, sf_dir):
    return context.select_context(_judged(spark, sf_dir))


_OWN, _SOURCES = "len(list_filter(picked, lambda p: p.source = r.source))", "len(list_distinct(list_transform(picked, lambda p: p.source)))"


@query(HIT_LOW_SQL + f""", us AS (SELECT *, bool_or(NOT low) OVER (PARTITION BY query) AS useful FROM hl),
gr AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY phase, pos, id) AS i, phase, id, source, lower(split_part(text, chr(10), 1)) AS topic FROM us, range(3) t(phase) WHERE NOT useful OR NOT low),
{_fold_sql("fo", "gr", "source topic", f"NOT {_has('p.id = r.id')} AND {_OWN} < 3 AND ({_OWN} > 0 OR {_SOURCES} < 8) AND len(picked) < 14 AND CASE r.phase WHEN 0 THEN {_SOURCES} < 3 AND {_OWN} = 0 WHEN 1 THEN NOT {_has('p.source = r.source AND p.topic = r.topic')} ELSE true END")}
SELECT * FROM fo_rows""")  # fmt: skip
def coverage_diverse(spark, sf_dir):
    return ranking.diverse(_judged(spark, sf_dir))


# --- evaluation and aggregates

EVAL_SQL = HITS_SQL + """,
ex AS (SELECT DISTINCT query, id FROM hi JOIN labels l ON l.doc_id = id AND l.quality = 1),
n AS (SELECT query, count(*) AS n FROM ex GROUP BY query), ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
fo AS (SELECT hi.query, k, count(*) AS found, min(pos) AS first FROM hi JOIN ex USING (query, id) JOIN ks ON pos <= k GROUP BY hi.query, k),
me AS (SELECT n.query, ks.k::INTEGER AS k, CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, coalesce(found::DOUBLE / n, 0) AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(found::DOUBLE / ks.k, 0) AS precision
  FROM n CROSS JOIN ks LEFT JOIN fo ON fo.query = n.query AND fo.k = ks.k)
"""


def _metrics(spark, sf_dir):
    results = _search(spark, sf_dir).select("query", "id", "rank")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return evaluation.metrics(results, results.join(good, "id", "left_semi"))


@query(EVAL_SQL + "SELECT query, k, hit, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(precision, 6) AS precision FROM me")
def eval_hit_recall_mrr(spark, sf_dir):
    """Hits that are labelled good count as expected."""
    return _metrics(spark, sf_dir).select("query", "k", "hit", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "precision")])


@query(EVAL_SQL + "SELECT k, round(avg(hit), 4) AS hit, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(precision), 4) AS precision, count(*) AS n FROM me GROUP BY k")
def eval_summary(spark, sf_dir):
    return evaluation.means(_metrics(spark, sf_dir)).select("k", *[F.round(c, 4).alias(c) for c in ("hit", "recall", "mrr", "precision")], "n")


@query(HITS_SQL + "SELECT query, source, count(*) AS n, round(max(score), 4) AS top, row_number() OVER (PARTITION BY query ORDER BY round(max(score), 6) DESC, min(pos))::INTEGER AS rank FROM hi GROUP BY query, source")
def sources_summary(spark, sf_dir):
    s = _hits(spark, sf_dir).groupBy("query", "source").agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("pos").alias("pos"))
    return vectors.ranked(s, ["query"], [F.round("top", 6).desc(), F.col("pos")]).select("query", "source", "n", F.round("top", 4).alias("top"), "rank")


@query(HITS_SQL + "SELECT query, lang AS scope, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM hi GROUP BY query, lang")
def sources_by_scope(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("query", F.col("lang").alias("scope")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("SELECT count(*) AS n, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents")
def collection_stats(spark, sf_dir):
    s = store.stats(table(spark, sf_dir, "documents"), ["lang", "source"])
    return s.select("n", F.array_join("lang", ",").alias("langs"), F.array_join("source", ",").alias("sources"))


@query("SELECT event_type, round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 4) AS mean, count(*) AS n FROM events GROUP BY event_type")
def value_timings(spark, sf_dir):
    t = evaluation.timings(table(spark, sf_dir, "events"), "event_type", "value")
    return t.select("event_type", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), F.round("mean", 4).alias("mean"), "n")


# --- store and families


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("parent"), F.col("turn").alias("place"), "role")


TURNS_SQL = "t AS (SELECT conv_id * 1000 + turn AS id, conv_id AS parent, turn AS place FROM conversations)"


@query(f"""WITH {TURNS_SQL}, h AS (SELECT parent // 10 AS query, id, parent, place, row_number() OVER (PARTITION BY parent // 10 ORDER BY id) AS pos FROM t WHERE place % 2 = 1),
p AS (SELECT h.query, u.id, 1 AS kind, h.pos, 0 AS place FROM h JOIN t u ON u.parent = h.parent AND u.place = 0),
s AS (SELECT h.query, u.id, 2 AS kind, h.pos, u.place FROM h JOIN t u ON u.parent = h.parent AND u.place > 0 AND u.id <> h.id QUALIFY row_number() OVER (PARTITION BY h.query, h.pos ORDER BY u.place) <= 2),
a AS (SELECT query, id, 0 AS kind, pos, 0 AS place FROM h UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s),
o AS (SELECT query, id, min(struct_pack(part := CASE WHEN kind = 0 THEN 0 ELSE 1 END, pos := pos, kind := kind, place := place)) AS met FROM a GROUP BY query, id)
SELECT query, id, CASE met.kind WHEN 0 THEN 'hit' WHEN 1 THEN 'parent' ELSE 'sibling' END AS relation, row_number() OVER (PARTITION BY query ORDER BY met)::INTEGER AS rank FROM o""")  # fmt: skip
def parent_child_expand(spark, sf_dir):
    """Odd turns are hits of the query of their ten conversations; turn 0 is the parent."""
    turns = _turns(spark, sf_dir)
    hits = vectors.ranked(turns.where("place % 2 = 1").select(F.expr("parent div 10").alias("query"), "id"), ["query"], [F.col("id")]).withColumnRenamed("rank", "pos")
    return store.expand_family(hits, turns.select("id", "parent", "place"))


@query(f"WITH {TURNS_SQL} SELECT a.id, count(*) FILTER (WHERE b.place = 0) AS parents, count(*) FILTER (WHERE b.place > 0) AS siblings FROM t a JOIN t b ON a.parent = b.parent AND a.id <> b.id GROUP BY a.id")
def related(spark, sf_dir):
    """How many relatives of each kind a turn has, by counts of its family (no pairs are made)."""
    turns = _turns(spark, sf_dir)
    family = turns.groupBy("parent").agg(F.count_if(F.col("place") == 0).alias("firsts"), F.count_if(F.col("place") > 0).alias("others"))
    out = turns.join(family, "parent").withColumns({"parents": F.col("firsts") - F.when(F.col("place") == 0, 1).otherwise(0), "siblings": F.col("others") - F.when(F.col("place") > 0, 1).otherwise(0)})
    return out.where("parents + siblings > 0").select("id", "parents", "siblings")


@query("WITH a AS (SELECT item_id AS query, unnest([item_id * 7, item_id, -1, item_id]) AS doc_id, unnest([0, 1, 2, 3])::INTEGER AS nth FROM benchmark) SELECT query, nth, a.doc_id, source FROM a LEFT JOIN documents d ON d.doc_id = a.doc_id")
def lookup_ordered(spark, sf_dir):
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.array(F.col("item_id") * 7, "item_id", F.lit(-1).cast("long"), "item_id").alias("ids"))
    return store.lookup(ids, table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("query", "nth", "doc_id", "source")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS nth, count(*) OVER (PARTITION BY source) AS total, total > 30 AS has_more FROM documents QUALIFY nth > 10 AND nth <= 30")
def document_page(spark, sf_dir):
    return store.page(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", 10, 20).select("source", "doc_id", "nth", "total", "has_more")


@query("SELECT source, count(*) FILTER (WHERE lang IN ('en', 'de')) AS kept, count(*) FILTER (WHERE NOT lang IN ('en', 'de')) AS dropped FROM documents GROUP BY source")
def scope_filter_drop_count(spark, sf_dir):
    keep = store.predicate({"lang": ["en", "de"]})
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


STATE_SQL = "c AS (SELECT o_orderkey, o_orderdate + CASE WHEN o_orderkey % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS stamp FROM orders WHERE o_orderkey % 7 <> 0), s AS (SELECT o_orderkey, o_orderdate AS stamp FROM orders WHERE o_orderkey % 10 <> 0)"


def _state(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    now = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", (F.col("o_orderdate") + F.when(F.col("o_orderkey") % 5 == 0, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day"))).alias("stamp"))
    return now, orders.where("o_orderkey % 10 <> 0").select("o_orderkey", F.col("o_orderdate").alias("stamp"))


@query(f"WITH {STATE_SQL} SELECT o_orderkey, CASE WHEN s.stamp IS NULL THEN 'new' WHEN c.stamp IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM c FULL JOIN s USING (o_orderkey) WHERE s.stamp IS NULL OR c.stamp IS NULL OR c.stamp > s.stamp")
def incremental_diff(spark, sf_dir):
    return store.changes(*_state(spark, sf_dir), "o_orderkey", "stamp")


@query(f"WITH {STATE_SQL}, u AS (SELECT * FROM s ANTI JOIN c USING (o_orderkey) UNION ALL SELECT * FROM c) SELECT o_orderkey, stamp FROM u WHERE o_orderkey % 11 <> 0")
def upsert_delete(spark, sf_dir):
    now, then = _state(spark, sf_dir)
    return store.deleted(store.upsert(then, now, "o_orderkey", "stamp"), then.where("o_orderkey % 11 = 0").unionByName(now.where("o_orderkey % 11 = 0")), "o_orderkey")


# --- queries as rows


GLOSSARY_SQL = "g AS (SELECT p_partkey AS entry, list_filter(string_split(lower(p_name), ' '), lambda x: len(x) > 1) AS terms, p_type AS expansion FROM part)"


@query(f"WITH {GLOSSARY_SQL}, t AS (SELECT entry, expansion, unnest(terms) AS term FROM g), m AS (SELECT DISTINCT item_id AS query, entry FROM benchmark JOIN t ON contains(lower(text), term)) SELECT b.item_id AS query, count(m.entry)::INTEGER AS matched FROM benchmark b LEFT JOIN m ON m.query = b.item_id GROUP BY b.item_id")
def glossary_expand(spark, sf_dir):
    """Words of part names as a glossary."""
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), F.filter(F.split(F.lower("p_name"), " "), lambda x: F.length(x) > 1).alias("terms"), F.array("p_type").alias("expansions"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return routing.expand_queries(asked, g).select("query", "matched")


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, CASE WHEN regexp_matches(lower(url), 'api') THEN 'api' WHEN regexp_matches(lower(url), 'flow') THEN 'flow' WHEN regexp_matches(lower(url), 'hardware|config') THEN 'hardware_config' WHEN regexp_matches(lower(url), 'guide') THEN 'guide' ELSE 'reference' END AS doc_type,
 CASE WHEN regexp_matches(lower(url), '/(fr|de|es)/') THEN 'foreign' WHEN regexp_matches(lower(html), 'lang="en"') THEN 'english' ELSE 'unknown' END AS family, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS stem FROM pages""")  # fmt: skip
def page_metadata(spark, sf_dir):
    url = F.col("url")
    family = metadata.cascade((url, [("/(fr|de|es)/", "foreign")]), (F.col("html"), [('lang="en"', "english")]), otherwise=F.lit("unknown"))
    return table(spark, sf_dir, "pages").select("page_id", metadata.host(url).alias("host"), metadata.doc_type(url).alias("doc_type"), family.alias("family"), metadata.safe_stem(url).alias("stem"))


# --- compositions and streams


def _retrieve(spark, sf_dir, broad):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.retrieve(asked, docs, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), broad=broad)


#: FUSED_SQL over vectors of documents only.
DOCUMENTS_SQL = FUSED_SQL.replace("AND q.id IN (SELECT item_id FROM benchmark)", "AND q.id IN (SELECT item_id FROM benchmark) AND v.id IN (SELECT doc_id FROM documents)")
NARROW_SQL = DOCUMENTS_SQL + r""",
hh AS (SELECT fr2.query, fr2.id, fr2.rank AS pos, fr2.score, d.text, d.source, b.text AS query_text, lower(split_part(d.text, chr(10), 1)) AS tl FROM fr2 JOIN documents d ON d.doc_id = fr2.id JOIN benchmark b ON b.item_id = fr2.query),
wt AS (SELECT item_id AS query, list_distinct(list_filter(string_split(lower(split_part(text, chr(10), 1)), ' '), lambda x: len(x) > 3)) AS terms FROM benchmark),
b0 AS (SELECT hh.*, coalesce(list_sum(list_transform(terms, lambda t: contains(tl, t)::INTEGER)), 0)::INTEGER AS m, len(terms) AS n FROM hh JOIN wt USING (query)),
b1 AS (SELECT * EXCLUDE (pos, score), score * (1 + 0.15::DOUBLE * m) AS score, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN n > 0 THEN round(score * (1 + 0.15::DOUBLE * m), 6) END DESC, pos)::INTEGER AS pos FROM b0),
r1 AS (SELECT *, m > 0 AS tm, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN pos <= 20 THEN 0 ELSE 1 END, NOT m > 0, pos) AS k FROM b1),
r2 AS (SELECT *, tm AND row_number() OVER (PARTITION BY query, source, tm ORDER BY k) <= 2 AS able FROM r1),
r3 AS (SELECT *, able AND sum(able::INTEGER) OVER (PARTITION BY query ORDER BY k) <= 3 AS early FROM r2),
r4 AS (SELECT *, row_number() OVER (PARTITION BY query, source ORDER BY early DESC, k) AS ins FROM r3 QUALIFY ins <= 2),
r5 AS (SELECT *, CASE WHEN early THEN 0 WHEN NOT bool_or(early) OVER (PARTITION BY query, source) AND ins = 1 THEN 1 ELSE 2 END AS phase FROM r4),
r6 AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY phase, k)::INTEGER AS shaped FROM r5 QUALIFY shaped <= 32),
ju AS (SELECT *, list_distinct(list_filter(string_split_regex(lower(query_text), '\s+'), lambda x: x <> '')) AS qa,
  list_filter(string_split_regex(lower(left(concat_ws(' | ', nullif(source, ''), nullif(split_part(text, chr(10), 1), '')) || chr(10) || text, 2400)), '\s+'), lambda x: x <> '') AS qb FROM r6),
be AS (SELECT *, round(len(list_intersect(qa, qb))::DOUBLE / greatest(len(qa), 1), 6) AS lexical, row_number() OVER (PARTITION BY query ORDER BY round(len(list_intersect(qa, qb))::DOUBLE / greatest(len(qa), 1), 6) DESC, id)::INTEGER AS place FROM ju QUALIFY place <= 5),
ti AS (SELECT query, id, 0 AS part, row_number() OVER (PARTITION BY query ORDER BY m DESC, round(score, 6) DESC, pos) AS place FROM b1 WHERE m > 0 QUALIFY place <= 3),
ke AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY min(struct_pack(part := part, place := place)))::INTEGER AS rank FROM (SELECT query, id, 1 AS part, place FROM be UNION ALL SELECT * FROM ti) GROUP BY query, id),
co AS (SELECT ke.query, ke.id, ke.rank, length(d.text) AS size, length(d.text) // 4 AS own, sum(length(d.text) // 4) OVER (PARTITION BY ke.query ORDER BY ke.rank) AS upto FROM ke JOIN documents d ON d.doc_id = ke.id),
cu AS (SELECT *, min(rank) FILTER (WHERE upto > 4000) OVER (PARTITION BY query) AS ov, 4000 - (upto - own) AS rest FROM co)
"""


@query(NARROW_SQL + "SELECT cu.query, cu.id, cu.rank, round(b1.score, 4) AS score, (CASE WHEN cu.rank = ov THEN least(size, rest * 4) // 4 ELSE own END)::BIGINT AS tokens FROM cu JOIN b1 ON b1.query = cu.query AND b1.id = cu.id WHERE ov IS NULL OR cu.rank < ov OR (cu.rank = ov AND rest > 100)")
def retrieve_narrow(spark, sf_dir):
    """The plan of retrieve() for every benchmark question."""
    return _retrieve(spark, sf_dir, False)


@query("WITH " + COUNTS_SQL.replace("50000", "5") + ", " + DOCUMENTS_SQL.removeprefix("WITH ").split(COUNTS_SQL + ", ")[1].split("fu AS")[0].rstrip(", \n") + """,
hi AS (SELECT de.query, b.text AS query_text, de.id, d.text, d.source, de.rank AS pos FROM de JOIN documents d ON d.doc_id = de.id JOIN benchmark b ON b.item_id = de.query WHERE de.query NOT IN (SELECT query FROM sp))""" + BM25_TAIL + """,
s2 AS (SELECT query, id, rank FROM sp UNION ALL SELECT query, id, rank FROM br),
fu AS (SELECT coalesce(de.query, s2.query) AS query, coalesce(de.id, s2.id) AS id, de.rank AS one, s2.rank AS two, round(coalesce(0.7::DOUBLE / (60 + de.rank), 0) + coalesce(0.3::DOUBLE / (60 + s2.rank), 0), 9) AS score FROM de FULL JOIN s2 ON de.query = s2.query AND de.id = s2.id)
SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, one NULLS LAST, two NULLS LAST)::INTEGER AS rank FROM fu""")  # fmt: skip
def hybrid_bm25_fallback(spark, sf_dir):
    """A vocabulary of five terms: questions without any of them take their dense candidates in order of their words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    counts = _counted(spark, sf_dir)
    corpus = retrieval.Corpus(counts, stored(vectors.vocabulary(counts, docs.count(), 5), "vocabulary"))
    return retrieval.searched(asked, docs, corpus, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")).select("query", "id", "score", "rank")


@query()
def retrieve_broad(spark, sf_dir):
    return _retrieve(spark, sf_dir, True)


@query("SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def stream_latest(spark, sf_dir):
    """Documents as a stream of files (a pattern, so that one file will do), upserted by source."""
    home = f"{ingest.work_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = ingest.stream_table(spark, f"{sf_dir}/documents.parque[t]").select("source", "doc_id", "lang")
    ingest.upsert_stream(rows, "source", "doc_id", f"{home}/table", f"{home}/checkpoint").awaitTermination()
    return ingest.read_latest(spark, f"{home}/table", "source", "doc_id").select("source", "doc_id", "lang")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    """The stream's aggregation over the table as it stands."""
    return ingest.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query(r"""
WITH l AS (SELECT conv_id AS id, (unnest(range(len(x))))::INTEGER AS pos, unnest(x) AS line FROM (SELECT conv_id, list(((turn % 3) + 1)::VARCHAR || ' ' || replace(left(split_part(text, chr(10), 1), 20), '=', '') || CASE WHEN turn % 2 = 0 THEN '=t' || turn ELSE '' END ORDER BY turn) AS x FROM conversations GROUP BY conv_id))
SELECT id, count(*) FILTER (WHERE NOT starts_with(line, '1 ') AND contains(line, '=t')) AS topics FROM l GROUP BY id""")  # fmt: skip
def contents_topics(spark, sf_dir):
    """Conversations written as .cnt files, a line for each turn, read back."""
    label = F.replace(F.left(text.title("text"), F.lit(20)), F.lit("="), F.lit(""))
    line = F.concat(((F.col("turn") % 3) + 1).cast("string"), F.lit(" "), label, F.when(F.col("turn") % 2 == 0, F.concat(F.lit("=t"), F.col("turn").cast("string"))).otherwise(""))
    files = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("cnt"))
    return help_files.contents_markdown(help_files.contents_lines(files, "id", "cnt")).select("id", "topics")


@query(f"""WITH {COUNTS_SQL}, ce AS (SELECT id, ('0x' || left(md5(term), 6))::BIGINT % 64 AS place, sum(tf) AS v FROM dc GROUP BY ALL), no AS (SELECT id, sqrt(sum(v * v)) AS n FROM ce GROUP BY id)
SELECT id AS doc_id, place, round(v / n, 6)::DOUBLE AS v FROM ce JOIN no USING (id)""")  # fmt: skip
def dense_encode_hashing(spark, sf_dir):
    out = vectors.hash_encode(_counts(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("place", "v"))
    return out.where("v > 0").select("doc_id", F.col("place").cast("long").alias("place"), F.round("v", 6).alias("v"))


@query(HITS_SQL + r""",
te AS (SELECT item_id AS query, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: len(x) >= 3) AS t FROM benchmark),
ph AS (SELECT query, t, list_transform(list_zip(t[:-2], t[2:]), lambda p: p[1] || ' ' || p[2]) AS p FROM te),
nb AS (SELECT hi.query, id, t, p, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(left(text, 5000)), '\s+', ' ', 'g')) AS b FROM hi JOIN ph USING (query))
SELECT query, id, len(list_filter(p, lambda x: contains(a, x)))::INTEGER AS title_phrases, len(list_filter(t, lambda x: contains(a, x)))::INTEGER AS title_terms,
 len(list_filter(p, lambda x: contains(b, x)))::INTEGER AS body_phrases, len(list_filter(t, lambda x: contains(b, x)))::INTEGER AS body_terms FROM nb""")  # fmt: skip
def context_priority(spark, sf_dir):
    out = ranking.match_priority(_hits(spark, sf_dir), F.col("query_text"), text.title("text"), F.col("text"))
    return out.select("query", "id", "title_phrases", "title_terms", "body_phrases", "body_terms")


@query(HIT_LOW_SQL + f""", gr AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY pos, id) AS i, id, source, lang AS canonical, left(sha256(text), 32) AS hash, lang <> source AND list_contains(list(source) OVER (PARTITION BY query), lang) AS variant FROM hl),
{_fold_sql("fo", "gr", "source canonical hash", f"NOT r.variant AND NOT {_has('p.id = r.id OR (p.source <> r.source AND (p.canonical = r.canonical OR p.hash = r.hash))')} AND len(list_filter(picked, lambda p: p.source = r.source)) < 3")} SELECT * FROM fo_rows""")
def dedup_variants(spark, sf_dir):
    """Hits whose languages stand for canonical sources and whose texts are hashed."""
    rows = _hits(spark, sf_dir).withColumns({"canonical": F.col("lang"), "hash": F.left(F.sha2("text", 256), F.lit(32))})
    return ranking.dedup_variants(rows)


@query(HITS_SQL + "SELECT query, id, CASE WHEN id % 2 = 0 THEN pos::DOUBLE ELSE -1000 END AS score FROM hi")
def rerank_missing_scores(spark, sf_dir):
    """A provider that scores even ids only."""
    hits = _hits(spark, sf_dir)
    given = hits.where("id % 2 = 0").select("query", "id", F.col("pos").cast("double").alias("score"))
    return ranking.with_scores(hits.drop("score"), given).select("query", "id", "score")


from loreweave.plans import assembly  # noqa: E402, F401 - registers its queries here
