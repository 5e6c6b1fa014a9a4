"""Operators on rows small enough to work out by hand."""

import pytest
from pyspark.sql import functions as F

from loreweave.functions import metadata, text
from loreweave.operators import chunking, context, evaluation, graph, ranking, routing, store, vectors
from loreweave.sources import files, html
from loreweave.sources import help as help_files
from loreweave.streaming import ingest
from test_chunking import chunks


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_tokens_keep_technical_words_whole(spark):
    assert one(spark, text.tokens("t"), t="Pin_Config.v2 data-set 漢字!") == ["pin_config.v2", "data-set", "漢", "字"]
    assert one(spark, text.tokens("t"), t=None) == []


def test_low_utility(spark):
    low = lambda t, kind="section", title="": one(spark, text.is_low_utility("t", F.lit(kind), [F.lit(title)]), t=t)
    assert low("") and low("Image: a picture of\nmany words.") and low("Release notes", title="release  NOTES") and low("scrap")
    assert not low("A sentence that says something useful about the tester and its pins.")
    assert low("Some text that is long enough to count as an answer, really.", kind="image")


def test_truncation_prefers_a_late_blank_line(spark):
    assert one(spark, text.truncated("t", 20), t="x" * 17 + "\n\n" + "y" * 9) == "x" * 17
    assert one(spark, text.truncated("t", 20), t="x" * 3 + "\n\n" + "y" * 30) == "x" * 3 + "\n\n" + "y" * 15
    assert one(spark, text.truncated("t", 20), t="short") == "short"


def test_links(spark):
    page = 'see [a](x.md "tip") and ![i](p.png) [b](b.htm#s) [b](b.htm) [c](http://h/c.md) <a href="d/e.html?q=1">d</a> [f](assets/f.md)'
    assert one(spark, text.links("t"), t=page) == ["x.md", "b.htm", "d/e.html"]


def test_chunker_outline(spark):
    text_ = "# Doc\nintro\n## One\nbody\n```python\nprint(1)\n```\n| a | b |\n|---|---|\n| 1 | 2 |\n![alt](p.png)\n## Two\nmore"
    out = chunks(spark, ("s.md", "Doc", text_))
    kinds = [c["chunk_type"] for c in out]
    assert kinds == ["document", "section", "section", "code_block", "table", "image", "section"]
    one_, two = out[2], out[6]
    assert one_["parent_id"] == out[1]["id"] and two["sibling_ids"] == [one_["id"]] and out[1]["id"] in out[0]["child_ids"]
    assert out[4]["content"] == "Table:\na | b\n1 | 2" and out[3]["content"] == "print(1)\n"
    assert [c["chunk_type"] for c in chunks(spark, ("s", "", ""))] == ["document", "section"]


def test_chunker_keeps_levels_once_seen(spark):
    heads = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 1), (1, 3, 3)], "id long, pos int, level int")
    assert rows(chunking.parents(heads), "pos", "parent") == [(0, -1), (1, 0), (2, -1), (3, 1)]


def test_chunk_documents_on_spark(spark):
    docs = spark.createDataFrame([("a.md", "A", "# H\n\n" + "para one. " * 60 + "\n\n" + "para two. " * 60), (None, None, None)], "s string, t string, x string")
    out = chunking.chunk_documents(docs, "s", "t", "x").groupBy("source_md", "chunk_type").count()
    assert rows(out, "source_md", "chunk_type", "count") == [("", "document", 1), ("", "section", 1), ("a.md", "document", 1), ("a.md", "paragraph", 2), ("a.md", "section", 1)]


def test_html_to_markdown():
    page = "<html><head><title>T</title></head><body><script>x</script><h1>Head &amp; tail</h1><p>One <a href='b.htm'>link</a><br>two<p><b>three<ul><li>x<li>y</ul><table><tr><td>a<td>b<tr><td>c</table><pre>code\n  here</pre></body>"
    assert html.to_markdown(page) == "# Head & tail\n\nOne [link](b.htm) two\n\nthree\n\n- x\n- y\n\n| a | b |\n| --- | --- |\n| c |  |\n\n```text\ncode\n  here\n```"
    assert html.to_markdown("<p>x", "Title") == "# Title\n\nx"
    assert html.to_markdown("") == ""


def test_html_classes_of_help_pages():
    page = """<html><head><title>Licences</title><script>skip()</script></head><body>
      <table class="navi"><tr><td>Previous</td></tr></table><div class="X_Breadcrumbs">Licences</div><img src="a.gif" alt="Next">
      <blockquote><div class="Chapter">Licences</div><div class="Body">Use the <a href="portal.html">portal</a>.</div>
        <div class="Bullet1_outer"><table><tr><td>•</td><td>A feature <div>licence</div></td></tr></table></div><div class="Number2">3. Third <code>x</code></div><div class="Heading3">Sub</div><p>end</blockquote></body></html>"""
    assert html.to_markdown(page) == "# Licences\n\nUse the [portal](portal.html).\n\n- A feature licence\n\n1. Third `x`\n\n### Sub\n\nend"


def test_html_body_is_the_first_blockquote_and_nav_stays():
    page = "<body><nav><ul><li><a href='a.htm'>A</a></li><li>B</li></ul></nav><p>text</p><template><p>kept</p></template></body>"
    assert html.to_markdown(page) == "- [A](a.htm)\n- B\n\ntext\n\nkept"
    page = "<body><h1>Out</h1><div><blockquote><h2>In</h2><blockquote>deeper</blockquote><p>more</blockquote></div><p>after</p><blockquote>second</blockquote></body>"
    assert html.to_markdown(page, "T") == "# T\n\n## In\n\ndeeper\n\nmore"
    assert html.to_markdown("<blockquote>open <table><tr><td>x<td>y<tr><td>z") == "open\n\n| x | y |\n| --- | --- |\n| z |  |"
    assert html.to_markdown("</blockquote><p>x</p>") == "x"


def test_chunker_follows_tables_lines_and_ids(spark):
    """Two piped lines without a separator are no table; sections have title, blank line, body; lines as they stand in the text."""
    body = "# A\nintro\n| x | y |\n| 1 | 2 |\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n```py\ncode\n```\n![alt](p.png)\n### Sub\n![i](q.png)"
    out = chunks(spark, ("s.md", "Doc", body, ["Top", "Doc"]), toc=True)
    got = {(c["chunk_type"], c["start_line"], c["end_line"], c["content"]) for c in out if c["chunk_type"] != "document"}
    assert got == {
        ("section", 0, 12, "A\n\nintro\n| x | y |\n| 1 | 2 |\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n```py\ncode\n```\n![alt](p.png)"), ("table", 5, 8, "Table:\na | b\n1 | 2"), ("code_block", 9, 11, "code\n"),
        ("image", 12, 12, "Image: alt (p.png)"), ("subsection", 13, 14, "Sub\n\n![i](q.png)"), ("image", 14, 14, "Image: i (q.png)"),
    }
    import hashlib

    named = lambda *x: hashlib.sha256("::".join(x).encode()).hexdigest()[:32]
    ids = {c["chunk_type"] + c["subsection_title"]: c["id"] for c in out}
    assert ids["document"] == named("s.md", "Doc", "doc", body[:200]) and ids["code_block"] == named("s.md", "A", "code", "code\n") and ids["imageSub"] == named("s.md", "", "img", "q.png")
    assert ids["table"] == named("s.md", "A", "table", "| a | b |\n|---|---|\n| 1 | 2 |\n") and out[-1]["toc_path"] == ["Top", "Doc", "Sub"]
    docs = spark.createDataFrame([("s", "T", "# H\n" + "w" * 5000, ["P"])], "s string, t string, x string, toc array<string>")
    assert {(r.chunk_type, len(r.content)) for r in chunking.chunk_documents(docs, "s", "t", "x", "toc").collect()} == {("document", 5004), ("section", 4000), ("paragraph", 5000)}


def test_help_links_and_paths(spark):
    got = one(spark, html.help_target(F.col("t")), t="ms-its:Dir\\Book.CHM::/html/p.htm#top")
    assert (got.archive, got.path, got.anchor) == ("book.chm", "html/p.htm", "top")
    assert one(spark, html.normal_path(F.col("b"), F.col("r")), b="a/b/c.md", r="../d/./e.md") == "a/d/e.md"
    assert one(spark, html.normal_path(F.col("b"), F.col("r")), b="a/b/c.md", r="/x.md") == "x.md"


def test_pages_link_to_files(spark):
    rel = lambda p, b: one(spark, html.relative_path(F.col("p"), F.col("b")), p=p, b=b)
    assert [rel("a/b/c.md", "a/b/d.md"), rel("a/x.md", "a/b/d.md"), rel("z/x.md", "a/b/d.md"), rel("x.md", "d.md"), rel("a/b.md", "d.md"), rel("a/b/a/c.md", "a/a/d.md")] == ["c.md", "../x.md", "../../z/x.md", "x.md", "a/b.md", "../b/a/c.md"]
    pages = spark.createDataFrame([(1, "One.chm", "html/a.htm", "one/html/a.md", "see [A [x]](b.htm#top), [B](ms-its:two.chm::/c.htm) [C](none.htm) [D](http://x/b.htm) [E](#in) [F](b.png) [G](b.htm)"), (2, "two.chm", "c.htm", "two/c.md", None), (3, "two.chm", "d.htm", "two/d.md", "[unclosed")], "page long, archive string, path string, md string, text string")
    targets = spark.createDataFrame([("one.chm", "html/b.htm", "one/html/b.md"), ("two.chm", "c.htm", "two/c.md")], "archive string, path string, target string")
    assert rows(help_files.relinked(pages, targets), "page", "text") == [(1, "see [A [x]](b.md#top), [B](../../two/c.md) [C](none.htm) [D](http://x/b.htm) [E](#in) [F](b.png) [G](b.md)"), (2, None), (3, "[unclosed")]


def test_graph(spark):
    pages = spark.createDataFrame([("a", ["b", "a", "zz", "b", "c"]), ("b", ["a"]), ("c", [])], "source string, targets array<string>")
    edges = graph.link_edges(pages)
    assert rows(edges, "src", "dst", "pos") == [("a", "b", 0), ("a", "c", 4), ("b", "a", 0)]
    near = graph.neighbors(edges)
    assert rows(near, "src", "dst", "nth") == [("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("c", "a", 1)]
    seeds = spark.createDataFrame([(1, "c", 0)], "query long, node string, nth long")
    assert rows(graph.expand(seeds, near), "node", "hop") == [("a", 1), ("b", 2), ("c", 0)]
    assert rows(graph.expand(seeds, near, budget=1), "node", "hop") == [("a", 1), ("c", 0)]
    hubs = seeds.select("query", F.lit("a").alias("node"))
    assert rows(graph.hub_priority(hubs, graph.neighbors(edges, reverse=False)), "node", "priority") == [("a", 3), ("b", 2), ("c", 2)]
    variants = spark.createDataFrame([("x.htm",), ("x_2.htm",), ("y_2.htm",)], "html_path string")
    assert rows(graph.canonical_pages(variants), "html_path", "canonical") == [("x.htm", "x.htm"), ("x_2.htm", "x.htm"), ("y_2.htm", "y_2.htm")]


def test_fusion_keeps_first_list_order_on_ties(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query long, id long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query long, id long, rank int")
    assert [r.id for r in ranking.fuse(a, b).orderBy("rank").collect()] == [11, 10, 12]
    assert [r.id for r in ranking.fuse(a, b, (0.5, 0.5)).where("id <> 11").orderBy("rank").collect()] == [10, 12]


def test_bm25_uses_the_candidates_only(spark):
    c = spark.createDataFrame([(1, "red fox", 1, "red fox jumps", 1), (1, "red fox", 2, "blue fox sleeps here", 2), (1, "red fox", 3, None, 3)], "query long, query_text string, id long, text string, pos int")
    got = {r.id: r.score for r in ranking.bm25(c).collect()}
    assert got[1] > got[2] >= got[3] == 0.0


def test_rerank_shape_caps(spark):
    data = [(1, i, i, "s1" if i < 6 else f"s{i}", "section" if i % 2 else "document", i in (4, 5, 7)) for i in range(1, 11)]
    df = spark.createDataFrame(data, "query long, id long, pos long, source string, kind string, title_match boolean")
    got = [(r.id, r.source) for r in ranking.shape_rerank_input(df, most=6).orderBy("rank").collect()]
    assert len(got) == 6 and sum(s == "s1" for _, s in got) <= 2 and [i for i, _ in got[:3]] == [5, 7, 4]


def test_diverse_prefers_new_sources_then_topics(spark):
    data = [(1, 1, 1, "a", "t", False), (1, 2, 2, "a", "t", False), (1, 3, 3, "a", "u", False), (1, 4, 4, "b", "t", False), (1, 5, 5, "c", "", True)]
    df = spark.createDataFrame(data, "query long, id long, pos int, source string, topic string, low boolean")
    assert [r.id for r in ranking.diverse(df, most=3, least_sources=2).orderBy("rank").collect()] == [1, 4, 3]


def test_confidence(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (1, 0.8, 2), (1, 0.6, 3), (2, 0.9, 1), (3, 0.5, 1)], "query long, score double, rank int")
    assert rows(ranking.confidence(df), "query", "confidence") == [(1, "high"), (2, "medium"), (3, "low")]


def test_budgets_differ(spark):
    df = spark.createDataFrame([(1, i, i, "x" * 400) for i in range(1, 6)], "query long, id long, pos int, content string")
    assert [r.tokens for r in context.compress(df, 250).orderBy("pos").collect()] == [100, 100]
    assert [r.tokens for r in context.compress(df, 350).orderBy("pos").collect()] == [100, 100, 100]
    assert [r.tokens for r in context.compress(df, 310, least_rest=5).orderBy("pos").collect()] == [100, 100, 100, 10]
    assert context.package(df, F.col("content"), 250).first().n == 3
    assert rows(context.scoped_package(df.withColumn("scope", F.lit("a")), F.col("content"), 250), "n", "tokens") == [(2, 200)]


def test_merge_and_select(spark):
    df = spark.createDataFrame([(1, 1, "s", "a", "p", "one"), (1, 2, "s", "a", "p", "two"), (1, 3, "s", "b", "p", "three")], "query long, pos int, source string, section string, kind string, content string")
    assert rows(context.merge_adjacent(df), "pos", "n", "content") == [(1, 2, "one\n\ntwo"), (3, 1, "three")]
    long_ = "word " * 40
    picks = spark.createDataFrame([(1, 1, 1, "s", long_ + "end", False), (1, 2, 2, "s", long_, False), (1, 3, 3, "s", "other text", False), (1, 4, 4, "s", "useless", True)], "query long, id long, pos int, source string, content string, low boolean")
    assert rows(context.select_context(picks), "id", "rank") == [(1, 1), (3, 2)]


def test_store(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, o int")
    batch = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, o int")
    assert rows(store.upsert(t, batch, "k", "o"), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(store.deleted(t, batch, "k"), "k") == [(1,)]
    assert rows(store.changes(batch.dropDuplicates(["k"]), t, "k", "o"), "k", "change") == [(1, "deleted"), (3, "new")]
    ids = spark.createDataFrame([(9, [2, 1, 2, 7])], "query long, ids array<long>")
    assert [(r.nth, r.v) for r in store.lookup(ids, t, "k").orderBy("nth").collect()] == [(0, "b"), (1, "a"), (2, "b"), (3, None)]
    assert t.where(store.predicate({"v": ["a", "b"], "o": 1})).count() == 2 and t.where(store.predicate({})).count() == 2
    p = store.page(t, ["o"], "k", 0, 1).first()
    assert (p.k, p.total, p.has_more, p.next_offset) == (1, 2, True, 1)


def test_metrics_divide_by_k(spark):
    got = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query long, id long, rank int")
    want = spark.createDataFrame([(1, 6), (1, 7), (2, 1)], "query long, id long")
    m = {(r["query"], r.k): (r.hit, r.recall, r.mrr, r.precision) for r in evaluation.metrics(got, want, (1, 5)).collect()}
    assert m[1, 1] == (0.0, 0.0, 0.0, 0.0) and m[1, 5] == (1.0, 0.5, 0.5, 0.2) and m[2, 5] == (0.0, 0.0, 0.0, 0.0)


def test_routing(spark):
    docs = spark.createDataFrame([("s1", "m1", "Alpha common", "x\n# Delta_1 one\nplain"), ("s2", "m2", "Beta common", None), (None, "m3", "Gamma", ""), ("s1", "m4", None, "## alpha.set of\n")], "scope string, source string, title string, text string")
    owners = routing.symbol_owners(docs, "scope", "title", "text")
    assert rows(owners, "symbol", "name", "scope") == [("alpha", "Alpha", "s1"), ("alpha.set", "alpha.set", "s1"), ("beta", "Beta", "s2"), ("delta_1", "Delta_1", "s1"), ("of", "of", "s1"), ("one", "one", "s1")]
    scopes = [routing.Scope("s1", "p", "P / One", ("soft one", "one ")), routing.Scope("s2", "p", "P / Two", ("soft two",)), routing.Scope("s3", "q", "Q / Three", ("soft three",))]
    platforms = (("p", ("plat p",)), ("q", ("plat q",)))
    asked = ["about ALPHA", "alpha and beta", "what about soft two", "nothing", "alpha on soft two", "beta on plat q", "soft two and soft three", "plat p", "plat q", None, "alpha on plat p"]
    q = spark.createDataFrame(list(enumerate(asked)), "query long, text string")
    got = {r["query"]: (r["mode"], r.scopes, r.correction, r.clarification) for r in routing.route(q, owners, scopes, platforms).collect()}
    notice = " belongs to P / {}, so the answer comes from there."
    assert got == {
        0: ("direct", ["s1"], "", ""), 1: ("clarification", [], "", "Which platform do you mean?"), 2: ("direct", ["s2"], "", ""), 3: ("clarification", [], "", "Which platform do you mean?"),
        4: ("direct", ["s1"], "Alpha" + notice.format("One"), ""), 5: ("direct", ["s2"], "Beta" + notice.format("Two"), ""), 6: ("comparison", ["s2", "s3"], "", ""),
        7: ("clarification", [], "", "Which software of p do you mean?"), 8: ("direct", ["s3"], "", ""), 9: ("clarification", [], "", "Which platform do you mean?"), 10: ("direct", ["s1"], "", ""),
    }
    one_each = routing.route(q, owners.limit(0), [scopes[0], scopes[2]], platforms)
    assert {r["query"]: (r["mode"], r.scopes) for r in one_each.collect()}[3] == ("comparison", ["s1", "s3"])
    by = routing.branches(routing.route(q, owners, scopes, platforms)).where("query = 6")
    found = spark.createDataFrame([(6, "s3", 1, "c"), (6, "s2", 1, "a"), (6, "s2", 2, "b")], "query long, scope string, pos int, id string")
    assert rows(routing.grouped(found, by), "id", "rank") == [("a", 1), ("b", 2), ("c", 3)]
    glossary = spark.createDataFrame([(1, ["Pin Map"], ["pinmap", "channel map"]), (2, ["dps"], ["power supply"])], "entry long, terms array<string>, expansions array<string>")
    out = {r["query"]: (r.matched, r.expanded) for r in routing.expand_queries(spark.createDataFrame([(1, "the pin map of DPS"), (2, "x")], "query long, text string"), glossary).collect()}
    assert out == {1: (2, "the pin map of DPS pinmap channel map power supply"), 2: (0, "x")}
    assert one(spark, routing.title_terms(F.col("t")), t='How does Pin Map use "level set"?') == ["pin map", "level set"]


def test_metadata(spark):
    assert one(spark, metadata.doc_type(F.col("t")), t="My_API_Guide.md") == "api" and one(spark, metadata.doc_type(F.col("t")), t="x.md") == "reference"
    assert one(spark, metadata.safe_stem(F.col("t")), t=" A  b-C!") == "a_b_c"


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# é")
    (tmp_path / "d" / "b.md").write_bytes(b"caf\xe9")
    (tmp_path / "d" / "a.json").write_text('{"title": "T", "toc_path": ["x", "y"]}')
    md = files.markdown_files(spark, str(tmp_path))
    assert sorted(r.text for r in md.collect()) == ["# é", "café"]
    both = files.with_sidecars(md, files.sidecars(spark, str(tmp_path)))
    assert sorted(((r.title, r.text) for r in both.collect()), key=str) == [("T", "# é"), (None, "café")]
    (tmp_path / "q.jsonl").write_text('{"id": "1", "query": "x"}\n\n{"id": "2"}\nnot json\n')
    good, bad = files.questions(spark, str(tmp_path / "q.jsonl"))
    assert good.count() == 1 and bad.count() == 2
    tree = spark.createDataFrame([([("a", "A", [("b", "B")]), ("c", "C", [])],)], "nodes array<struct<href:string,label:string,children:array<struct<href:string,label:string>>>>")
    assert rows(files.toc_rows(tree), "href", "parent_href") == [("a", ""), ("b", "a"), ("c", "")]


def test_stream_upsert(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, o int").write.parquet(source)
    run = lambda: ingest.upsert_stream(ingest.stream_table(spark, source), "k", "o", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k long, v string, o int").write.mode("append").parquet(source)
    run()
    assert rows(ingest.read_latest(spark, str(tmp_path / "out"), "k", "o"), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]


def test_help_files(spark):
    toc = '<ul><li><object><param name="Name" value="Top"><param name="Local" value="t.htm"></object><ul><li><object><param name="Name" value="Sub"><param name="Local" value="s.htm"></object></ul><li><object><param name="Name" value="Next"><param name="Local" value="n.htm"></object></ul>'
    assert help_files.outline(toc, ["Root"]) == {"t.htm": ["Root", "Top"], "s.htm": ["Root", "Top", "Sub"], "n.htm": ["Root", "Next"]}
    f = spark.createDataFrame([("a", toc)], "id string, text string")
    assert rows(help_files.toc_paths(f, "id", "text", F.lit("R")), "local")[0] == ("n.htm",)
    cnt = spark.createDataFrame([("c", ":Title x\r\n1 Head\r\n2 Topic = id\n3 Deep\n\n")], "id string, text string")
    got = help_files.contents_markdown(help_files.contents_lines(cnt, "id", "text")).first()
    assert (got.markdown, got.topics) == ("## Head\n- Topic (`id`)\n  - Deep", 1)
    packs = spark.createDataFrame([("d/Book.HLP",), ("d/other.hlp",)], "path string")
    assert rows(help_files.manifests(packs, spark.createDataFrame([("e/book.cnt", 4)], "path string, topics int")), "path", "topics") == [("d/Book.HLP", 4), ("d/other.hlp", 0)]
    raw = spark.createDataFrame([(bytearray(b"\x00hello\xff----\x01world!\x02hello"),)], "content binary")
    assert raw.select(help_files.printable_strings(F.col("content")).alias("x")).first().x == ["hello", "world!"]
    pages = spark.createDataFrame([("p", "book.chm", "html/a.htm", ["b.htm#x", "ms-its:Other.chm::/c.htm", "zz.htm"])], "page string, archive string, path string, hrefs array<string>")
    targets = spark.createDataFrame([("Book.chm", "html/b.htm", "b.md"), ("other.chm", "c.htm", "c.md")], "archive string, path string, target string")
    assert rows(help_files.resolve_links(pages, targets), "href", "target", "anchor") == [("b.htm#x", "b.md", "x"), ("ms-its:Other.chm::/c.htm", "c.md", ""), ("zz.htm", None, "")]


@pytest.mark.parametrize("parts", [1, 7])
def test_order_does_not_depend_on_partitions(spark, parts):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(40)], "id long, embedding array<float>").repartition(parts)
    got = [(r["query"], r.id) for r in vectors.dense_top_k(v.where("id < 3"), v, 3).orderBy("query", "rank").collect()]
    assert got == [(0, 3), (0, 6), (0, 9), (1, 4), (1, 7), (1, 10), (2, 5), (2, 8), (2, 11)]


def test_variants_turned_away_claim_nothing(spark):
    data = [(1, 1, 1, "x", "c", "h1"), (1, 2, 2, "y", "d", "h1"), (1, 3, 3, "z", "d", "h2"), (1, 4, 4, "c", "c", "h3"), (1, 1, 5, "x", "c", "h1")]
    df = spark.createDataFrame(data, "query long, id long, pos int, source string, canonical string, hash string")
    # x isn't its canonical c, which is there; so y keeps hash h1, and z may not share d with it.
    assert [r.id for r in ranking.dedup_variants(df).orderBy("rank").collect()] == [2, 4]


def test_schema_and_profile(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    assert store.checked(v, {"id": "bigint"}, 2).count() == 1
    with pytest.raises(ValueError):
        store.checked(v, {"id": "string"})
    with pytest.raises(Exception, match="another width"):
        store.checked(v, {}, 3).collect()
    assert store.profile_key({"a": 1, "b": 2}) == store.profile_key({"b": 2, "a": 1}) != store.profile_key({"a": 1})


def test_hash_encoder_is_unit_length(spark):
    docs = spark.createDataFrame([(1, "one two two three"), (2, "")], "id long, text string")
    out = vectors.hash_encode(vectors.term_counts(docs, "id", "text"), 8).collect()
    assert [r.id for r in out] == [1] and sum(x * x for x in out[0].embedding) == pytest.approx(1.0) and len(out[0].embedding) == 8


def test_plans(spark):
    """The cases of a planner: precedence, families, versions, blocks, vague questions, glossaries that don't fit."""
    rules = routing.PlanRules(
        ecosystems=(("b", ("flow tool",)), ("a", ("sheet", "a-soft")), ("b", ("pin config",))), families=(("design", None, ("to digital",)), ("b_seven", "b", ("seven",))), defaults=(("a", "a_help"),),
        versions=(("b", (("v7", ("seven", "7.x")), ("v8", ("eight",)))),), apart=("design",), vague=(("b", ("version",)),), disabled=("a",), broad=("what is",),
    )
    asked = ["the sheet", "sheet of the flow tool", "pin config seven", "flow tool to digital", "which version of flow tool", "flow tool eight version", None, "the limit", "What is x"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "query long, text string")
    glossary = spark.createDataFrame([(1, ["limit"], ["bound"], "a", None, "a_help"), (2, ["flow"], ["course"], "a", None, None), (3, ["tool"], ["device"], None, "v7", None)], "entry long, terms array<string>, expansions array<string>, ecosystem string, software string, family string")
    got = {r["query"]: r for r in routing.plan(q, rules, glossary).collect()}
    assert [(got[i].ecosystem, got[i].family, got[i].blocked, got[i].ambiguous) for i in range(9)] == [("a", "a_help", True, False), ("b", None, False, False), ("b", "b_seven", False, False), ("b", "design", False, False), ("b", None, False, True), ("b", None, False, False), (None, None, False, False), ("a", "a_help", True, False), (None, None, False, False)]
    assert [got[i].filter_software for i in range(6)] == [None, None, ["v7", ""], None, None, ["v8", ""]] and got[3].filter_family == "design"
    assert got[1].expanded == "sheet of the flow tool device" and got[7].title_terms == ["bound", "limit"] and got[8].broad and not got[0].broad
    scoped = routing.plan(q.withColumn("scope_software", F.lit("v8")), rules, glossary).where("query = 4").first()
    assert (scoped.ecosystem, scoped.ambiguous, scoped.expanded) == ("b", False, asked[4])


def test_broad_context_against_plain_loops(spark):
    """Seeds, discovery, representatives and priorities, step by step without joins."""
    from loreweave.operators import broad

    words = lambda n, s: " ".join(f"{s}{i}." for i in range(n))
    chunks = []
    for s in range(12):
        chunks.append((s * 10, f"m{s:02d}", "document", f"Pin map {s}" if s in (2, 5) else f"Title {s}", words(30 if s % 3 else 5000, f"d{s}x")))
        chunks += [(s * 10 + k, f"m{s:02d}", "section", f"Part {k}", words(20 * k, f"s{s}k{k}y") if k != 2 else "short") for k in (1, 2, 3, 4)]
    df = broad.judged(spark.createDataFrame(chunks, "id long, source string, kind string, title string, content string"), F.col("kind"), [F.col("title")])
    edges = spark.createDataFrame([(f"m{s:02d}", f"m{(s + d) % 12:02d}", p) for s in range(12) for p, d in enumerate((1, 5)) if s not in (7, 8)], "src string, dst string, pos int")
    hits = spark.createDataFrame([(1, 1, 22), (1, 2, 21), (1, 3, 51), (1, 4, 23)], "query long, pos int, id long")
    queries = spark.createDataFrame([(1, "the pin map here")], "query long, query_text string")
    listed = hits.join(df, "id")
    assert rows(broad.seed_sources(listed), "node", "nth") == [("m02", 1), ("m05", 2)]
    seen = ["m02", "m05"]
    near = {r.src: [] for r in edges.collect()}
    for r in sorted(rows(graph.neighbors(edges), "src", "nth", "dst")):
        near.setdefault(r[0], []).append(r[2])
    frontier = list(seen)
    for _ in range(2):
        fresh = []
        for i in range(5):
            for s in frontier:
                if i < len(near.get(s, [])) and near[s][i] not in seen:
                    seen.append(near[s][i])
                    fresh.append(near[s][i])
        frontier = fresh
    found = broad.discover(broad.seed_sources(listed), graph.neighbors(edges))
    assert [r[1] for r in sorted(rows(found, "nth", "node"))] == seen
    stands = {r.source: [] for r in df.collect()}
    for r in sorted(broad.representatives(df).collect(), key=lambda r: (r.source, r.nth)):
        stands[r.source].append((r.id, r.score))
    for s in range(12):
        assert stands[f"m{s:02d}"] == ([(s * 10, 0.45)] if s % 3 else [(s * 10 + 4, 0.4), (s * 10 + 3, 0.4)])
    out = broad.prioritised(queries, found, df, graph.neighbors(edges, reverse=False)).orderBy("pos").collect()
    assert [r.priority for r in out] == sorted((r.priority for r in out), reverse=True) and {r.source for r in out if r.priority == 3} == {"m02", "m05"}
    chosen = [r.id for r in broad.assemble(queries, hits, df, edges).orderBy("rank").collect()]
    assert set(chosen[:2]) == {20, 50} and len(chosen) == 16 and len(set(chosen)) == 16
    contract = spark.range(1).select(broad.answer_contract(F.lit("direct"), F.lit(True), F.array(F.lit("t"), F.lit("t"))).alias("c")).first().c
    assert (contract.kind, contract.topics, contract.notice) == ("broad", ["t"], "")


def test_enrichment_and_slices(spark):
    from loreweave.operators import results

    chunks = spark.createDataFrame([(1, "a", "document", None), (2, "a", "section", 1), (3, "a", "paragraph", 2), (4, "b", "document", None), (5, "b", "paragraph", 99), (6, None, "table", None)], "id long, source string, kind string, parent_id long")
    hits = spark.createDataFrame([(1, 5, 1, 0.9), (1, 3, 2, 0.8), (1, 6, 3, 0.7)], "query long, id long, pos int, score double")
    assert rows(results.enrich(hits, chunks), "pos", "id", "added", "score") == [(1, 5, 0, 0.9), (2, 3, 0, 0.8), (3, 6, 0, 0.7), (4, 2, 1, 0.0), (5, 1, 2, 0.5), (6, 4, 2, 0.5)]
    assert rows(results.search_enriched(hits, chunks, top_k=2, budget=2), "rank", "id") == [(1, 5), (2, 3), (3, 6), (4, 2)]
    assert results.enrich(hits.limit(0), chunks).count() == 0
    lim = spark.createDataFrame([(True,), (False,)], "b boolean").select(results.result_limit(F.col("b"), 10).alias("n"))
    assert sorted(r.n for r in lim.collect()) == [13, 16]
    assert results.merged_filters({"a": 1, "b": 2}, {"b": 3}) == {"a": 1, "b": 3} == results.merged_filters({"a": 1}, {"b": 3}) | {}
    t = spark.createDataFrame([("x" * 9 + " " + "y" * 500, None)], "content string, tags array<string>")
    assert t.select(results.preview(F.col("content"), 20).alias("p")).first().p == "xxxxxxxxx..." and t.select(results.preview(F.lit(None).cast("string")).alias("p")).first().p == ""
    assert results.with_defaults(t.select("tags"), {"tags": "array<string>", "score": "double", "name": "string"}).first() == ([], 0.0, "")


def test_metadata_gates(spark):
    from loreweave.functions import metadata

    assert metadata.configured_scopes({"scopes": [{"vendor": "v", "platform": "p", "software": "s"}]}) == [("v", "p", "s")]
    assert metadata.configured_scopes({"platforms": {"p": {"vendor": "v", "versions": ["a", "b"]}, "q": {"vendor": "w", "enabled": False, "versions": ["c"]}}}) == [("v", "p", "a"), ("v", "p", "b")]
    assert one(spark, metadata.scope_of_path(F.col("t"), (("igs", "A"), ("seven", "B"))), t="Docs/SEVEN/x.md") == "B"
    assert one(spark, metadata.fits_whole(F.col("t"), (r"\d+_.*", "toc")), t="12_a.md") is True and one(spark, metadata.fits_whole(F.col("t"), ("toc",)), t="a toc") is False
    scope = one(spark, metadata.scope_of(F.col("t"), F.lit(None).cast("string"), (("e", "", "v", "p"),)), t="e")
    assert tuple(scope) == ("v", "p", "") and one(spark, metadata.scope_of(F.col("t"), F.lit("z"), (("e", "", "v", "p"),)), t="e") is None


def test_catalogue_refuses_older_forms(spark, tmp_path):
    from loreweave.sources import catalogue

    old, new = f"{tmp_path}/old", f"{tmp_path}/new"
    spark.createDataFrame([("a", 1)], "term string, index int").write.parquet(old)
    with pytest.raises(ValueError, match="another form"):
        catalogue.load(spark, old)
    assert catalogue.load(spark, new) is None and catalogue.load_owners(spark, new).count() == 0
    calls = []
    fit = lambda: calls.append(1) or spark.createDataFrame([("a", len(calls))], "term string, index int")
    assert [catalogue.fitted_once(spark, new, fit, force).first()["index"] for force in (False, False, True)] == [1, 1, 2]


def test_rebuild_and_state(spark):
    state = store.all_current(spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "path string, stamp long"), "k")
    assert rows(state, "path", "stamp", "profile") == [("a", 3, "k"), ("b", 2, "k")]
    assert not store.needs_rebuild(state, "k") and store.needs_rebuild(state, "other") and store.needs_rebuild(None, "k") and store.needs_rebuild(state.limit(0), "k")
    runs = spark.createDataFrame([(1, None, 10.0), (2, "timeout", 30.0)], "query long, error string, ms double")
    assert rows(evaluation.totals(runs), "n", "failed", "mean_ms") == [(2, 1, 20.0)] and evaluation.totals(runs.limit(0)).first().n == 0
    assert evaluation.markdown_report(spark.createDataFrame([(1, 0.5)], "k int, hit double")) == "| k | hit |\n| --- | --- |\n| 1 | 0.5 |\n"


def test_markdown_text(spark):
    from loreweave.functions import markdown

    polish = lambda t: one(spark, markdown.polished(F.col("t")), t=t)
    assert polish("see[Diff-Err, GainErr [%]](topic.md) from theStartmenu underOpen STDF File toanalyze data") == "see [Diff-Err, GainErr [%]](topic.md) from the Startmenu under Open STDF File to analyze data"
    assert polish("x.[a](b.md)then![i](p.png)more Danger:hot. A_BorC_D, dgen_2bitordgen_16bit") == "x. [a](b.md) then![i](p.png) more Danger: hot. A_B or C_D, dgen_2bit or dgen_16bit"
    assert polish("[a](b)[c](d) (e[f](g)) \n[h](i)\n Note:Note:x xNote:y") == "[a](b)[c](d) (e [f](g)) \n[h](i)\n Note: Note: x xNote:y"
    assert polish("\u00a0a\u2013b\u200bc \t d\n") == "a-bc d" and polish(None) is None and polish("") == ""
    assert polish("[" + "x" * 200_000) == "[" + "x" * 200_000  # a long label that never ends
    assert one(spark, markdown.images_in(F.col("t"), "../assets"), t="![a](p.png) ![b](x/q.png) [c](d.png) ![d](page.htm) ![e](A b.JPG) ![f](.png)") == "![a](../assets/p.png) ![b](x/q.png) [c](d.png) ![d](page.htm) ![e](../assets/A b.JPG) ![f](.png)"
    docs = spark.createDataFrame([(1, "[a](x.htm#q) ![i](x.htm) [b](y.htm) end"), (2, None), (3, "no link")], "id long, body string")
    known = spark.createDataFrame([("x.htm", "../x.md"), ("x.htm", "../z.md")], "target string, new string")
    assert rows(markdown.rewritten_links(docs, "id", "body", known), "id", "body") == [(1, "[a](../x.md#q) ![i](x.htm) [b](y.htm) end"), (2, None), (3, "no link")]


def test_selection_takes_nulls_and_ids_of_any_type(spark):
    rows_ = spark.createDataFrame([("q", "a", 1, "s", "One thing that is said here. " * 3, None, None, None), ("q", "b", 2, None, None, False, "t", ""), ("q", "c", 3, "s", "Another thing that is said. " * 3, True, None, "h")], "query string, id string, pos int, source string, content string, low boolean, topic string, hash string")
    assert rows(context.select_context(rows_), "id", "rank") == [("a", 1), ("b", 2)]
    assert rows(ranking.diverse(rows_), "id", "rank") == [("a", 1), ("b", 2)]
    assert rows(ranking.dedup_variants(rows_.withColumn("canonical", F.col("source"))), "id", "rank") == [("a", 1), ("b", 2), ("c", 3)]
    merged = context.merge_adjacent(rows_.withColumns({"section": F.lit(None).cast("string"), "kind": F.lit("k")}))
    assert rows(merged, "pos", "n") == [(1, 1), (2, 1), (3, 1)] and merged.where("pos = 2").first().content == ""
    empty = rows_.limit(0)
    assert context.select_context(empty).count() == ranking.diverse(empty).count() == 0
    none = spark.createDataFrame([], "query long, id long, rank int")
    some = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3)], "query long, id long, rank int")
    assert rows(ranking.fuse(none, some), "rank", "id") == [(1, 7), (2, 8)]
    trees = spark.createDataFrame([(None,), ([],)], "nodes array<struct<href:string,label:string,children:array<struct<href:string,label:string>>>>")
    assert files.toc_rows(trees).count() == 0


def test_greedy_selections_are_folds_of_arrays(spark):
    rows_ = spark.createDataFrame([(1, 1, 1, "s", "t", "some words", False)], "query long, id long, pos int, source string, topic string, content string, low boolean")
    for out in (context.select_context(rows_), ranking.diverse(rows_), ranking.dedup_variants(rows_.selectExpr("*", "source as canonical", "'' as hash"))):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan and out.count() == 1
