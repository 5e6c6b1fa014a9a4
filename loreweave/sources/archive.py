"""A folder of help files of several kinds as one table: pages, contents, packages, plain texts and print files.

Files are read by Spark's binary source, so a folder may lie in any store and every
file is a row. What a file is follows from its ending; its text is decoded once,
and what can't be read as text gives its printable strings. A file that yields no
text is a row with a warning; files of no bytes at all are not listed by the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources import help as help_files
from loreweave.sources import html

#: Kinds by ending, and the least length of a printable string by kind.
KINDS = {"htm": "page", "html": "page", "txt": "text", "cnt": "contents", "hlp": "package", "chm": "archive", "pdf": "print"}
STRINGS = {"package": 4, "archive": 6, "print": 6}
#: Where Windows-1252 differs from Latin-1, as characters of both.
_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([c]).decode("windows-1252", "ignore") or chr(c) for c in range(0x80, 0xA0))


def decoded(content: Column) -> Column:
    """Bytes as text: by their byte order mark, as UTF-8 if they are, else as Windows-1252."""
    marked = F.hex(F.substring(content, 1, 3))
    plain = F.when(marked == "EFBBBF", F.expr("substring(content, 4)")).otherwise(content)
    wide = F.decode(content, "UTF-16")
    return F.when(marked.startswith("FFFE") | marked.startswith("FEFF"), wide).when(F.is_valid_utf8(plain.cast("string")), plain.cast("string")).otherwise(F.translate(F.decode(plain, "ISO-8859-1"), _LATIN, _WINDOWS))


def title_of(path: Column) -> Column:
    """A file's name as a title: no folder, no ending, words apart and capitalised."""
    stem = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
    return F.initcap(F.trim(F.regexp_replace(stem, r"[_\-\s]+", " ")))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, length, content): the files below a folder whose kind is known; path: from the folder on."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    top = folder.rstrip("/").split(":")[-1].lstrip("/")
    own = F.regexp_replace(F.expr("replace(url_decode(replace(path, '+', '%2B')), '\\\\', '/')"), "^.*?/" + _quoted(top) + "/", "")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[ending]
    return rows.select(own.alias("path"), kind.alias("kind"), "length", "content").where("kind is not null")


def _quoted(x: str) -> str:
    return "\\Q" + x + "\\E"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, title, text, topics, warning), a row for each file of known kind below a folder.

    Pages become Markdown (title: their title element, else their name). Contents
    become headings and bullets; topics: how many of their lines have a target.
    Packages name the contents file of the same stem. Archives and print files give
    their printable strings, with a warning. Files that hold no text: an empty text
    and a warning. A folder without such files: no rows.
    """
    rows = files(spark, folder)
    name = title_of(F.col("path"))
    raw = rows.where(F.col("kind").isin("page", "text", "contents")).select("path", "kind", decoded(F.col("content")).alias("raw"))

    pages = raw.where("kind = 'page'")
    title = F.coalesce(F.nullif(html.tidy(html.page_title(F.col("raw"))), F.lit("")), name)
    pages = pages.select("path", "kind", title.alias("title"), "raw").select("path", "kind", "title", html.tidy(html.markdown(F.col("raw"), F.col("title"))).alias("text"), F.lit(None).cast("long").alias("topics"))

    plain = raw.where("kind = 'text'").select("path", "kind", name.alias("title"), F.col("raw").alias("text"), F.lit(None).cast("long").alias("topics"))

    listed = raw.where("kind = 'contents'")
    told = help_files.contents_markdown(help_files.contents_lines(listed, "path", "raw")).select(F.col("id").alias("path"), "markdown", "topics")
    contents = listed.select("path", "kind", name.alias("title")).join(told, "path", "left")
    contents = contents.select("path", "kind", "title", F.coalesce("markdown", F.lit("")).alias("text"), F.coalesce("topics", F.lit(0)).cast("long").alias("topics"))

    binary = rows.where(F.col("kind").isin(*STRINGS))
    strings = F.coalesce(*[F.when(F.col("kind") == k, F.array_join(help_files.printable_strings(F.col("content"), n), "\n")) for k, n in STRINGS.items()])
    other = help_files.manifests(binary.select("path", "kind", name.alias("title"), strings.alias("strings")), contents.select("path", "topics"))
    named = F.when(F.col("cnt_path").isNotNull(), F.concat(F.lit("Contents: `"), "cnt_path", F.lit("`\n"), F.col("topics").cast("string"), F.lit(" topics")))
    # A package that has contents needs none of its strings.
    text = F.when((F.col("kind") == "package") & named.isNotNull(), named).otherwise(F.col("strings"))
    other = other.select("path", "kind", "title", text.alias("text"), F.when(F.col("kind") == "package", F.col("topics")).cast("long").alias("topics"))

    out = pages.unionByName(plain).unionByName(contents).unionByName(other)
    warning = F.when(F.trim("text") == "", "no text").when(F.col("kind").isin("archive", "print"), "printable strings only")
    return out.withColumn("warning", warning)
