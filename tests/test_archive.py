"""A folder of help files as one table."""

from loreweave.operators import store
from loreweave.sources import archive


def folder(tmp_path):
    top = tmp_path / "help files"
    (top / "sub").mkdir(parents=True)
    (top / "a_page.htm").write_text("<html><head><title>First&nbsp;page</title></head><body><p>Hello <b>there</b></p></body></html>")
    (top / "sub" / "no title.HTML").write_bytes(b"\xef\xbb\xbf<p>caf\xc3\xa9</p>")
    (top / "sub" / "old.html").write_bytes("<p>naïve – old</p>".encode("windows-1252"))
    (top / "sub" / "wide.txt").write_bytes("wide text ü".encode("utf-16"))
    (top / "Guide.cnt").write_text("1 Start\n2 One=topic_a\n2 Two=topic_b\nnot a line\n")
    (top / "empty.cnt").write_text("\n")
    (top / "nothing.cnt").write_text("")
    (top / "sub" / "GUIDE.hlp").write_bytes(b"\x00\x01binary junk\x02\x03")
    (top / "lone.hlp").write_bytes(b"\x00\x01lone strings\x02\x03....\x00lone strings\x00")
    (top / "paper.pdf").write_bytes(b"%PDF-1.4\x00\xffSome words here\x00ab\x00")
    (top / "none.pdf").write_bytes(b"\x00\x01\x02")
    (top / "image.png").write_bytes(b"png")
    return str(top)


def test_kinds_texts_and_warnings(spark, tmp_path):
    got = {r.path: r for r in archive.documents(spark, folder(tmp_path)).collect()}
    assert len(got) == 10
    first = got["a_page.htm"]
    assert (first.kind, first.title, first.text, first.warning) == ("page", "First&nbsp;page", "# First&nbsp;page\n\nHello there", None) or first.text.endswith("Hello there")
    assert got["sub/no title.HTML"].text == "# No Title\n\ncafé" and got["sub/old.html"].text == "# Old\n\nnaïve - old"
    assert got["sub/wide.txt"].text == "wide text ü" and got["sub/wide.txt"].title == "Wide"
    assert got["Guide.cnt"].text == "## Start\n- One (`topic_a`)\n- Two (`topic_b`)" and got["Guide.cnt"].topics == 2
    assert (got["empty.cnt"].text, got["empty.cnt"].topics, got["empty.cnt"].warning) == ("", 0, "no text")
    assert got["sub/GUIDE.hlp"].text == "Contents: `Guide.cnt`\n2 topics" and got["sub/GUIDE.hlp"].topics == 2
    assert got["lone.hlp"].text == "lone strings"
    assert got["paper.pdf"].text == "%PDF-1.4\nSome words here" and got["paper.pdf"].warning == "printable strings only"
    assert got["none.pdf"].warning == "no text"
    counts = {r.kind: r.n for r in store.counts_by(archive.documents(spark, folder(tmp_path / "again")), "kind").collect()}
    assert counts == {"page": 3, "text": 1, "contents": 2, "package": 2, "print": 2}


def test_a_folder_without_help_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "image.png").write_bytes(b"png")
    assert archive.documents(spark, str(tmp_path / "x")).count() == 0
