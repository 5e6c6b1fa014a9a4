"""The chunker's plan against a plain loop over one document at a time."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loreweave.operators import chunking
from loreweave.operators.chunking import PARAGRAPHS_FROM

HEADING = r"^(#{1,4})\s+(.+)$"
CODE = r"```(\w+)?\n(.*?)```"
TABLE = r"(\|[^\n]+\|\n\|[-:\s|]+\|\n(?:\|[^\n]+\|\n?)+)"
IMAGE = r"!\[(.*?)\]\((.+?)\)"
NAMES = [x.split()[0] for x in chunking.SCHEMA.split(", ")]
DOC = "s string, t string, x string"


def named(*parts: str) -> str:
    return hashlib.sha256("::".join(parts).encode()).hexdigest()[:32]


def _table_text(raw: str) -> str:
    """A table's cells, its separator row left out."""
    rows = [x.strip() for x in raw.strip().splitlines() if x.strip()]
    cells = [" | ".join(c.strip() for c in x.split("|") if c.strip()) for x in rows[:1] + rows[2:]]
    return "Table:\n" + cells[0] + "\n" + "\n".join(cells[1:])


def _media(text: str) -> list[tuple[str, str, int, int, str, str]]:
    """(kind, suffix of its id, first line, last line, content, what its id is made of) of code, then tables, then images."""
    found = []
    for pattern, kind, suffix, flags in ((CODE, "code_block", "code", re.S), (TABLE, "table", "table", 0), (IMAGE, "image", "img", 0)):
        for m in re.finditer(pattern, text, flags):
            content, key = {"code": lambda m: (m[2], m[2][:200]), "table": lambda m: (_table_text(m[1]), m[1][:200]), "img": lambda m: (f"Image: {m[1]} ({m[2]})", m[2])}[suffix](m)
            first = text.count("\n", 0, m.start())
            found.append((kind, suffix, first, first + m[0].count("\n"), content, key))
    return found


def document_chunks(source: str, title: str, text: str, toc_path: list[str] | None = None) -> list[dict]:
    """Chunks of one Markdown text: the document, then for each heading its section, paragraphs, code, tables and images. Contents are whole."""
    lines_, base = text.splitlines(), list(toc_path or [title])
    marks = [(text.count("\n", 0, m.start()), len(m[1]), m[2].strip()) for m in re.finditer(HEADING, text, re.M)]
    ends = [at - 1 for at, *_ in marks[1:]] + [len(lines_) - 1]
    sections = [(level, name, "\n".join(lines_[at + 1 : end + 1]), at, end) for (at, level, name), end in zip(marks, ends, strict=False)] or [(1, "", text, 0, len(lines_) - 1)]
    media, out, families = _media(text), [], {}

    def add(kind, key, level, names, span, content, parent, path):
        row = dict(zip(NAMES, (named(source, *key), len(out), source, title, kind, *names, level, *span, content, parent and parent["id"], [], [], path), strict=True))
        out.append(row)
        if parent:
            families.setdefault(parent["id"], []).append(row)
            parent["child_ids"].append(row["id"])
        return row

    last = {0: add("document", (title, "doc", text[:200]), 0, ("", ""), (0, 0), text, None, base)}
    for level, name, body, start, end in sections:
        names, path = ((name, "") if level <= 2 else ("", name)), [*base, name]
        own = add("section" if level <= 2 else "subsection", (name, f"h{level}", body[:200]), level, names, (start, end), f"{name}\n\n{body}".strip(), last[max(n for n in last if n < level)], path)
        last[level] = own
        if len(body) > PARAGRAPHS_FROM:
            for i, part in enumerate(x.strip() for x in re.split(r"\n\s*\n", body) if x.strip()):
                add("paragraph", (name, f"para-{i}", part), level, names, (start, end), part, own, path)
        for kind, suffix, first, until, content, key in media:
            if start <= first <= end:
                add(kind, (names[0], suffix, key), level, names, (first, until), content, own, path)
    for family in families.values():
        ids = [x["id"] for x in family]
        for row in family:
            row["sibling_ids"] = [x for x in ids if x != row["id"]]
    return out


def chunks(spark, *docs, toc=False):
    """Rows of each document in order, as dicts."""
    df = spark.createDataFrame(list(docs), DOC + (", toc array<string>" if toc else ""))
    return [r.asDict() for r in chunking.chunk_documents(df, "s", "t", "x", "toc" if toc else None).orderBy("source_md", "pos").collect()]


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["# One", "## Two  ", "### Three", "#### Four", "#\tTabbed", "#No", "##### Five", "#", "# \n", "plain words", "é ü", "", "", "  ", "x" * 300, "word " * 60, "```", "```py", "```\ncode\n```", "```c++\nno\n```", "```py\nprint(1)\n\nx```after",
             "| a | b |\n|---|---|\n| 1 | 2 |", "| a |\n|:-:|\n| 1 |\n| |\n|2|3|", "| a | b |\n| c | d |", "|x|\n| - |\n\n| y |", "![i](p.png)", "text ![a b](c/d e.png) ![](x)", "![[n]](m.png)", "a\rb", "c\r\nd", "e\x0cf", "g\u2028h", "\u3000wide\u3000", "# \u00a0Spaced\u2003"]
    return ["\n".join(rng.choices(parts, k=rng.randrange(0, 40))) + rng.choice(["", "\n", "\n\n"]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(2))
def test_plan_agrees_with_a_plain_loop(spark, seed):
    """Headings over two lines, open fences, tables without rows, images in text, and every kind of line end."""
    docs = [(f"d{i:03}.md", f"T{i}", x) for i, x in enumerate(texts(seed, 120))]
    got = {}
    for r in chunks(spark, *docs):
        got.setdefault(r["source_md"], []).append(r)
    for source, title, text in docs:
        want = document_chunks(source, title, text)
        assert [{k: v for k, v in r.items() if k != "content"} for r in got[source]] == [{k: v for k, v in r.items() if k != "content"} for r in want], repr(text)
        for a, b in zip(got[source], want, strict=True):
            most = chunking.MOST_CHARS.get(a["chunk_type"])
            assert a["content"] == b["content"] or len(b["content"]) > most >= len(a["content"]) > 0.5 * most


def test_odd_documents(spark):
    same = ("s", "T", "# A\n\nbody")
    got = chunks(spark, same, same, (None, None, None), ("z", None, "\n" * 3))
    kinds = [(r["source_md"], r["chunk_type"]) for r in got]
    assert sorted(kinds) == [("", "document"), ("", "section"), *[("s", "document")] * 2, *[("s", "section")] * 2, ("z", "document"), ("z", "section")]
    assert chunking.chunk_documents(spark.createDataFrame([], DOC), "s", "t", "x").count() == 0


def test_a_table_of_many_rows_and_a_long_text(spark):
    table = "| a | b |\n|---|---|\n" + "".join(f"| {i} | x |\n" for i in range(60_000))
    got = chunks(spark, ("s", "T", "# H\n" + table + "\n```py\n" + "code\n" * 100_000 + "```\n" + "w " * 400_000))
    kinds = {r["chunk_type"]: r for r in got}
    assert kinds["table"]["content"].count("\n") == 60_001 and kinds["table"]["end_line"] == 60_003 and len(kinds["code_block"]["content"]) == 500_000


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("s", "T", "# A\nb")], DOC)
    plan = chunking.chunk_documents(df, "s", "t", "x")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert chunking.chunk_documents(df.withColumn("pos", F.lit(1)), "s", "t", "x").count() == 2


def test_paragraphs_lose_spaces_only(spark):
    """A paragraph that starts or ends with the digit of its own place keeps it; spaces go."""
    parts = ["0 first 0", "1 second 1", "  2 third 2 ", "   ", "y" * PARAGRAPHS_FROM]
    got = spark.createDataFrame([("\n\n".join(parts),)], "x string").select(chunking.paragraphs(F.col("x")).alias("p")).first().p
    assert got == ["0 first 0", "1 second 1", "2 third 2", "y" * PARAGRAPHS_FROM]


def test_printable_strings_keep_their_digits(spark):
    from loreweave.sources import help as help_files

    raw = spark.createDataFrame([(b"0abc0\x00  1abc1 \x00",)], "x binary")
    assert raw.select(help_files.printable_strings(F.col("x")).alias("p")).first().p == ["0abc0", "1abc1"]


def test_contents_cut_at_their_length_below_a_long_title(spark, tmp_path):
    """Section contents as the SQL of section_chunks has them, where a title ends near the longest length."""
    import duckdb

    from loreweave.plans.queries import ORACLE_SQL, QUERIES

    long_ = lambda c, n: (c * 7 + " ") * (n // 8) + c * (n % 8)
    lines = ["head1", "body", long_("t", 1700), "b" * 801, "c" * 1002, long_("u", 1715), "d" * 403]
    spark.createDataFrame([(1, "\n".join(lines)), (2, "w" * 3001 + "\nx")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["section_chunks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['section_chunks']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 4
