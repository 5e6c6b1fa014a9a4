"""Legacy help formats: tables of contents, manifests, printable strings, and links between converted files."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.markdown import ONE_WAY_LINK
from loreweave.sources.html import help_target, normal_path, relative_path, tidy


class _Outline(HTMLParser):
    """Nested lists of objects with a name and a target; keeps the names above each target."""

    def __init__(self, above: list[str]):
        super().__init__()
        self.path, self.depths, self.found = list(above), [], {}
        self.values: dict[str, str] | None = None

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        if tag == "ul":
            self.depths.append(len(self.path))
        elif tag == "li" and self.depths:
            del self.path[self.depths[-1] :]
        elif tag == "object":
            self.values = {}
        elif tag == "param" and self.values is not None and values.get("value"):
            self.values[values.get("name", "").lower()] = " ".join(values["value"].split())

    def handle_endtag(self, tag):
        if tag == "object" and self.values is not None:
            if self.values.get("name") and self.values.get("local"):
                self.path.append(self.values["name"])
                self.found[self.values["local"]] = list(self.path)
            self.values = None
        elif tag == "ul" and self.depths:
            del self.path[self.depths.pop() :]


def outline(text: str, above: list[str]) -> dict[str, list[str]]:
    """Target -> names from the outermost list down; of equal targets the last."""
    reader = _Outline(above)
    reader.feed(text or "")
    reader.close()
    return reader.found


def _outlines(texts: pd.Series, roots: pd.Series) -> pd.Series:
    return pd.Series([outline(t, [r]) for t, r in zip(texts.fillna(""), roots.fillna(""), strict=True)])


def toc_paths(files: DataFrame, id_col: str, text_col: str, root: Column) -> DataFrame:
    """(id, local, toc_path) of help project contents files, a row for each target."""
    found = F.pandas_udf(_outlines, "map<string,array<string>>")(F.col(text_col), root)
    return files.select(F.col(id_col).alias("id"), F.explode(found).alias("local", "toc_path"))


def contents_lines(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, level, label, target) of .cnt files: lines of a level, a label and maybe =target; other lines are left out."""
    rows = files.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("pos", "line"))
    line = F.trim("line")
    rest = F.regexp_extract(line, r"^\d+\s+(.+)$", 1)
    out = rows.where(line.rlike(r"^\d+\s+.+$")).select("id", "pos", F.regexp_extract(line, r"^(\d+)", 1).cast("int").alias("level"), tidy(F.regexp_extract(rest, r"^([^=]*)", 1)).alias("label"), tidy(F.regexp_extract(rest, r"^[^=]*=(.*)$", 1)).alias("target"))
    return out.where("label <> ''")


def contents_markdown(lines: DataFrame) -> DataFrame:
    """(id, markdown, topics): headings and nested bullets of contents lines, and how many have a target."""
    bullet = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 2, F.lit(0))), F.lit("- "), F.col("label"), F.when(F.col("target") != "", F.concat(F.lit(" (`"), F.col("target"), F.lit("`)"))).otherwise(""))
    row = F.when(F.col("level") <= 1, F.concat(F.lit("## "), F.col("label"))).otherwise(bullet)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", row.alias("row")))), lambda x: x["row"]), "\n")
    return lines.groupBy("id").agg(text.alias("markdown"), F.count_if((F.col("level") > 1) & (F.col("target") != "")).alias("topics"))


def manifests(packages: DataFrame, contents: DataFrame) -> DataFrame:
    """packages (path) with cnt_path and topics of the contents file (path, topics) of the same stem, whatever the case."""
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", ""))
    c = contents.select(stem(F.col("path")).alias("stem"), F.col("path").alias("cnt_path"), "topics")
    return packages.withColumn("stem", stem(F.col("path"))).join(c, "stem", "left").withColumn("topics", F.coalesce("topics", F.lit(0))).drop("stem")


def printable_strings(content: Column, least: int = 4) -> Column:
    """Distinct runs of printable ASCII of at least so many characters, trimmed, without those of marks alone."""
    runs = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(runs, lambda x: F.trim(x)), lambda x: x.rlike("[A-Za-z0-9]")))


def resolve_links(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """(page, href, target, anchor) of pages (page, archive, path, hrefs): links of help pages to converted files, null where there is none.

    targets: (archive, path, target). A link without an archive stays in its own;
    its path counts from the page's folder.
    """
    rows = pages.select("page", "archive", "path", F.explode("hrefs").alias("href")).withColumn("to", help_target(F.col("href")))
    to_archive = F.when(F.col("to.archive") != "", F.col("to.archive")).otherwise(F.lower("archive"))
    to_path = F.when(F.col("to.archive") != "", normal_path(F.lit(""), F.col("to.path"))).otherwise(normal_path(F.col("path"), F.col("to.path")))
    asked = rows.select("page", "href", to_archive.alias("a"), F.lower(to_path).alias("p"), F.col("to.anchor").alias("anchor"))
    t = targets.select(F.lower("archive").alias("a"), F.lower("path").alias("p"), "target")
    return asked.join(t, ["a", "p"], "left").select("page", "href", "target", "anchor")



def relinked(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """(page, text) of pages (page, archive, path, md, text): links to other help pages lead to their Markdown files, seen from md.

    targets: (archive, path, target), target a file as md is. Labels may hold
    brackets; anchors stay. Links to other sites, within the page, to what is no
    page and to pages without a file stay as they are. Null text: null.
    """
    links = F.regexp_extract_all("text", F.lit(ONE_WAY_LINK), F.lit(0))
    href = lambda link: F.regexp_extract(link, r"(?s)\]\(([^)]+)\)$", 1)
    own = F.filter(F.array_distinct(F.transform(links, href)), lambda h: ~h.rlike(r"^(https?://|mailto:|data:|#)") & F.lower(F.regexp_replace(h, r"[?#].*$", "")).rlike(r"\.html?$"))
    found = resolve_links(pages.select("page", "archive", "path", own.alias("hrefs")), targets).where("target is not null")
    new = F.concat(relative_path(F.col("target"), F.col("md")), F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")).otherwise(""))
    maps = found.join(pages.select("page", "md"), "page").groupBy("page", "href").agg(F.min(new).alias("new")).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("href", "new"))).alias("_new"))
    turned = F.transform(links, lambda x: F.concat(F.regexp_replace(x, r"(?s)\]\([^)]+\)$", "]("), F.coalesce(F.try_element_at("_new", href(x)), href(x)), F.lit(")")))
    body = F.array_join(F.zip_with(F.split("text", ONE_WAY_LINK, -1), turned, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return pages.join(maps, "page", "left").select("page", F.when(F.col("_new").isNull(), F.col("text")).otherwise(body).alias("text"))
