"""Markdown text: spacing, links and images, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import WHITE

#: What a link is (label, target, fragment); a link whose label may hold brackets.
LINK = r"(?<!!)\[([^\]]*)\]\(([^)\s#]+)(#[^)\s]*)?\)"
WHOLE_LINK = r"\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]\([^)]+\)"
#: The same where a match can be had in one way only, so that Java needs no recursion over long labels.
ONE_WAY_LINK = r"\[[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+\]\([^)]+\)"
#: Endings of images.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "bmp", "webp")
#: Words that a colon makes labels, and pairs of words that sources glue together.
LABELS = ("Note", "Caution", "Warning", "Danger")
GLUED = (("the", "Startmenu"), ("under", "Open"), ("to", "analyze"), ("and", "difficult"))
#: A name with an underscore, as one of two that "or" was glued between.
NAME = r"[A-Za-z][A-Za-z0-9]*_\w+"


def plain_spaces(text: Column) -> Column:
    """Non-breaking spaces and dashes in plain form, no zero-width spaces, one blank for a run of blanks; line feeds stay, but not at the ends."""
    plain = F.replace(F.translate(text, "\u00a0\u2011\u2013\u2014", " ---"), F.lit("\u200b"), F.lit(""))
    return F.trim(F.regexp_replace(plain, r"[ \t\r\f\x0B]+", " "), F.lit(WHITE))


def polished(text: Column, glued: Sequence[tuple[str, str]] = GLUED) -> Column:
    """Markdown with the spaces that its source has lost.

    The text is taken apart into links and what stands between. What ends in a
    letter, digit or , . ; : gets a space before a link, what begins with a letter
    or digit one after it (images have their ! before them, so none goes there).
    Then labels get one after their colon, names one on either side of an "or"
    between them, and glued pairs of words one in their middle. Null text: null.
    """
    link = ONE_WAY_LINK
    between, links = F.split(text, link, -1), F.regexp_extract_all(text, F.lit(link), F.lit(0))
    blank = lambda when: F.when(when, " ").otherwise("")
    last = F.size(between) - 1
    spaced = F.transform(between, lambda x, i: F.concat(blank((i > 0) & x.rlike("^[A-Za-z0-9]")), x, blank((i < last) & x.rlike(r"[A-Za-z0-9,.;:]\z"))))
    out = F.array_join(F.zip_with(spaced, links, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = F.regexp_replace(out, rf"(?U)\b({'|'.join(LABELS)}):(?=\S)", "$1: ")
    out = F.regexp_replace(out, rf"(?U)\b({NAME})or({NAME})\b", "$1 or $2")
    for first, second in glued:
        out = F.regexp_replace(out, rf"(?U)\b{first}{second}\b", f"{first} {second}")
    return plain_spaces(out)


def images_in(text: Column, folder: str) -> Column:
    """Links of images that are a file's name alone point into a folder; other links stay."""
    name = rf"\s*[^)/\\\s][^)/\\]*\.(?i:{'|'.join(IMAGE_ENDINGS)})\s*"
    return F.regexp_replace(text, rf"!\[([^\]]*)\]\(({name})\)", rf"![$1]({folder}/$2)")


def rewritten_links(docs: DataFrame, id_col: str, text_col: str, known: DataFrame) -> DataFrame:
    """docs' (id, text) with the targets of links replaced by what known (target, new) says; fragments stay, unknown targets too.

    Null text: null. Targets that known has several times: the smallest new name.
    """
    new = known.groupBy("target").agg(F.min("new").alias("new"))
    found = docs.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(text_col, F.lit(LINK), F.lit(2)))).alias("target")).join(new, "target")
    maps = found.groupBy(id_col).agg(F.map_from_entries(F.collect_set(F.struct("target", "new"))).alias("_new"))
    labels, targets, parts = (F.regexp_extract_all(text_col, F.lit(LINK), F.lit(i)) for i in (1, 2, 3))
    links = F.zip_with(labels, F.zip_with(targets, parts, lambda t, f: F.concat(F.coalesce(F.try_element_at("_new", t), t), F.coalesce(f, F.lit("")))), lambda a, b: F.concat(F.lit("["), a, F.lit("]("), b, F.lit(")")))
    between = F.split(text_col, LINK)
    body = F.array_join(F.zip_with(between, links, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    return docs.join(maps, id_col, "left").select(id_col, F.when(F.col("_new").isNull(), F.col(text_col)).otherwise(body).alias(text_col))
