"""HTML pages as Markdown, in Arrow batches with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loreweave.functions.markdown import plain_spaces

_SKIP = {"script", "style", "noscript", "head"}
_VOID = {"br", "img", "hr", "meta", "link", "input", "area", "base", "col", "wbr"}
_BLOCKS = {"p", "div", "article", "section", "body", "html", "main", "header", "footer", "blockquote", "table", "ul", "ol", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}


#: Classes of tables and elements that only lead elsewhere, alternative texts of their images, and div classes that are headings, bullets and numbers.
NAVIGATION, TRAIL, ARROWS = {"navi", "hidden"}, "breadcrumb", {"", "next", "previous", "print", "collapse", "expanded"}
MARKS = (("Chapter", "# "), ("Heading1", "# "), ("Heading2", "## "), ("Heading3", "### "))
LISTS = (("Bullet", "- "), ("Number", "1. "))


def _mark(classes: list[str]) -> str | None:
    """What Markdown puts before the text of a div of such classes, if anything."""
    whole = next((mark for name, mark in MARKS if name in classes), None)
    return whole or next((mark for start, mark in LISTS if any(c.startswith(start) for c in classes)), None)


class _Reader(HTMLParser):
    """Collects blocks of Markdown while the tags go by; tags may be left open.

    A page's first blockquote, if there is one, is all of its body.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.quotes, self.done = 0, False  # blockquotes open, and whether the first one has ended
        self.clear()

    def clear(self) -> None:
        self.blocks: list[str] = []
        self.run: list[str] = []
        self.skip: list[str] = []
        self.head, self.pre, self.href = 0, False, []
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.rows: list[list[str]] | None = None
        self.marked: list | None = None  # [mark, open divs] inside a div that its class makes a heading or an item

    def close_marked(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.run).replace("\xa0", " ")).strip()
        mark, self.run, self.marked = self.marked[0], [], None
        text = text.lstrip("•").strip() if mark == "- " else re.sub(r"^\d+[.)]\s*", "", text) if mark == "1. " else text
        if text:
            self.blocks.append(mark + text)

    def close_run(self) -> None:
        text = "".join(self.run)
        text = text.strip("\n") if self.pre else re.sub(r"\s+", " ", text.replace("\xa0", " ")).strip()
        self.run = []
        if not text:
            return
        if self.row is not None:
            self.row.append(text)
        elif self.pre:
            self.blocks.append(f"```text\n{text}\n```")
        elif self.head:
            self.blocks.append("#" * self.head + " " + text)
        elif self.lists:
            kind, n = self.lists[-1]
            self.lists[-1][1] = n + 1
            mark = "- " if kind == "ul" else f"{n + 1}. "
            line = "  " * (len(self.lists) - 1) + mark + text
            if self.blocks and self.blocks[-1].lstrip()[:2] in ("- ", "1.") and n:
                self.blocks[-1] += "\n" + line
            else:
                self.blocks.append(line)
        else:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "blockquote" and not self.skip:
            if not self.quotes:
                self.clear()
            self.quotes += 1
        if self.skip or tag in _SKIP:
            if tag not in _VOID:
                self.skip.append(tag)
            return
        values = dict(attrs)
        classes = (values.get("class") or "").split()
        if tag not in _VOID and (tag == "table" and NAVIGATION.intersection(classes) or any(TRAIL in c.lower() for c in classes)):
            self.skip.append(tag)
            return
        if self.marked:
            self.marked[1] += tag == "div"
            if tag not in ("a", "img", "code", "tt"):
                self.run.append(" ")
                return
        elif tag == "div" and (mark := _mark(classes)):
            self.close_run()
            self.marked = [mark, 1]
            return
        if tag in _BLOCKS or tag in ("li", "tr", "td", "th"):
            self.close_run()
        if re.fullmatch("h[1-6]", tag):
            self.head = int(tag[1])
        elif tag == "pre":
            self.pre = True
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "table":
            self.rows = []
        elif tag == "tr":
            self.close_row()
            self.row = []
        elif tag == "br":
            self.run.append("\n" if self.pre else " ")
        elif tag == "a" and values.get("href"):
            self.href.append((len(self.run), values["href"]))
        elif tag in ("code", "tt") and not self.pre:
            self.run.append("`")
        elif tag == "img" and values.get("src") and (values.get("alt") or "").strip().lower() not in ARROWS:
            self.run.append(f"![{values.get('alt') or ''}]({values['src']})")

    def handle_endtag(self, tag):
        if self.done:
            return
        if tag == "blockquote" and self.quotes and not self.skip:
            self.quotes -= 1
            if not self.quotes:
                self.finish()
                self.done = True
                return
        if self.skip:
            if tag in self.skip:
                del self.skip[len(self.skip) - 1 - self.skip[::-1].index(tag) :]
            return
        if self.marked and tag not in ("a", "code", "tt"):
            self.marked[1] -= tag == "div"
            self.run.append(" ")
            if not self.marked[1]:
                self.close_marked()
            return
        if tag in _BLOCKS or tag in ("li", "tr", "td", "th"):
            self.close_run()
        if re.fullmatch("h[1-6]", tag):
            self.head = 0
        elif tag == "pre":
            self.pre = False
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "tr":
            self.close_row()
        elif tag == "table" and self.rows is not None:
            self.close_row()
            self.table(self.rows)
            self.rows = None
        elif tag == "a" and self.href:
            at, href = self.href.pop()
            text = re.sub(r"\s+", " ", "".join(self.run[at:])).strip()
            self.run[at:] = [f"[{text}]({href})"] if text else []
        elif tag in ("code", "tt") and not self.pre:
            self.run.append("`")

    def close_row(self) -> None:
        if self.row and self.rows is not None:
            self.rows.append(self.row)
        self.row = None

    def handle_data(self, data):
        if not self.skip and not self.done:
            self.run.append(data)

    def finish(self) -> None:
        if self.marked:
            self.close_marked()
        self.close_run()
        if self.rows is not None:
            self.close_row()
            self.table(self.rows)
            self.rows = None

    def table(self, rows: list[list[str]]) -> None:
        if len(rows) == 1:
            self.blocks.append(" ".join(rows[0]))
        elif rows:
            width = max(map(len, rows))
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            lines.insert(1, "|" + " --- |" * width)
            self.blocks.append("\n".join(lines))


def to_markdown(html: str, title: str = "") -> str:
    """Markdown of one page; the title as first heading unless the page begins with one."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.finish()
    blocks = reader.blocks
    if title and not (blocks and blocks[0].startswith("# ")):
        blocks = [f"# {title}", *blocks]
    return "\n\n".join(blocks)


def _markdown(html: pd.Series, title: pd.Series) -> pd.Series:
    return pd.Series([to_markdown(h, t) for h, t in zip(html.fillna(""), title.fillna(""), strict=True)])


def markdown(html: Column, title: Column | None = None) -> Column:
    """Markdown column of an HTML column; null pages give the title alone, or an empty text."""
    return F.pandas_udf(_markdown, "string")(html, F.lit("") if title is None else title)


def page_title(html: Column) -> Column:
    """What stands in the title element, trimmed; empty if there is none."""
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def tidy(text: Column) -> Column:
    """Non-breaking and zero-width spaces, dashes and runs of blanks in their plain form; line feeds stay."""
    return plain_spaces(text)


def help_target(href: Column) -> Column:
    """struct(archive, path, anchor) of a help link such as ms-its:a.chm::/p.htm#x; a plain path has no archive."""
    bare = F.regexp_replace(href, r"(?i)^(mk:@MSITStore:|ms-its:)", "")
    archive = F.lower(F.regexp_extract(bare, r"(?i)([^/\\]+\.chm)::", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?i)^.*\.chm::/?", ""), r"[?#].*$", ""), r"\\", "/")
    return F.struct(archive.alias("archive"), path.alias("path"), F.regexp_extract(bare, r"#(.*)$", 1).alias("anchor"))


def normal_path(base: Column, relative: Column) -> Column:
    """A relative link seen from the file base: its folder with . and .. worked out; an absolute one from the root."""
    folder = F.regexp_replace(base, r"[^/]*$", "")
    parts = F.split(F.when(relative.startswith("/"), relative).otherwise(F.concat(folder, relative)), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def relative_path(path: Column, base: Column) -> Column:
    """A path as a link from the file base: what both share goes, a .. for each folder of base that is left."""
    here, there = F.split(F.regexp_replace(base, r"(^|/)[^/]*$", ""), "/"), F.split(path, "/")
    here = F.filter(here, lambda x: x != "")
    most = F.least(F.size(here), F.size(there) - 1)
    steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))
    shared = F.aggregate(steps, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(here, i - 1) == F.get(there, i - 1)), i).otherwise(n))
    up = F.array_repeat(F.lit(".."), (F.size(here) - shared).cast("int"))
    return F.array_join(F.concat(up, F.slice(there, shared + 1, F.size(there))), "/")
