"""Text expressions: tokens, normal forms, quality rules. All of them Spark columns, no Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a technical token keeps its inner dots, dashes and underscores; a CJK character is a token.
TOKEN = r"[a-z0-9]+(?:[_.\-][a-z0-9]+)*|[一-鿿]"
#: Section titles that carry no answer, contents that are an image alone, and bonuses by kind of chunk.
LOW_VALUE_TITLES = ("functional changes", "related information")
BARE_IMAGE = r"(?s)^\s*(?:Image:\s*.+|!\[[^\]]*\]\([^)]+\))\s*$"
KIND_BONUS = {"document": 0.24, "section": 0.18, "subsection": 0.16, "table": 0.16, "list": 0.10, "paragraph": 0.08, "code_block": 0.04, "image": -1.0}
#: White space of Unicode, as characters.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(text: Column | str) -> Column:
    """Tokens of a text in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def plain_words(text: Column | str) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(col(text), F.lit(""))), r"\s+"), lambda x: x != "")


def normalized(text: Column | str) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.array_join(plain_words(text), " ")


def title(text: Column | str) -> Column:
    """First line of a text."""
    return F.split(col(text), "\n").getItem(0)


def token_estimate(text: Column | str) -> Column:
    """Four characters to a token, rounded down."""
    return F.floor(F.length(col(text)) / 4)


def is_low_utility(content: Column | str, kind: Column, titles: list[Column]) -> Column:
    """Chunks that should take no place in an answer: empty, images, bare titles, low-value sections, scraps.

    titles: section title first, then the other titles of the chunk.
    """
    norm = normalized(content)
    named = [normalized(x) for x in titles]
    bare = F.trim(col(content)).rlike(BARE_IMAGE)
    size = F.length(norm)
    scrap = (size < 40) & ~norm.rlike("[.:;!?。；：]")
    title_only = (size < 80) & norm.isin(*named)
    return (norm == "") | (kind == "image") | bare | named[0].isin(*LOW_VALUE_TITLES) | (norm.startswith("functional changes") & (size < 600)) | title_only | scrap


def quality_bonus(content: Column | str, kind: Column, titles: list[Column]) -> Column:
    """A small adjustment for useful chunks: kind, length up to 6000 characters, links up to four; -1 if of low utility."""
    c = col(content)
    by_kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KIND_BONUS.items() for x in pair]), kind), F.lit(0.0))
    links = (F.length(c) - F.length(F.replace(c, F.lit("]("), F.lit("")))) / 2
    bonus = by_kind + F.least(F.length(c), F.lit(6000)) / 6000 * 0.12 + F.least(links, F.lit(4)) * 0.03
    return F.when(is_low_utility(content, kind, titles), -1.0).otherwise(bonus)


def coverage_topic(subsection: Column, section: Column, doc_title: Column, source: Column) -> Column:
    """First title that isn't empty, trimmed; else the source."""
    first = F.coalesce(*[F.when(x != "", x) for x in (subsection, section, doc_title)], F.lit(""))
    return F.when(F.trim(first) != "", F.trim(first)).otherwise(source)


def truncated(content: Column | str, most: int) -> Column:
    """At most so many characters; cut at the last blank line if that keeps over 80 percent."""
    c = col(content)
    head = F.left(c, F.lit(most))
    back = F.instr(F.reverse(head), "\n\n")
    at = F.lit(most) - back - 1  # characters before the last blank line
    return F.when(F.length(c) <= most, c).when((back > 0) & (at > 0.8 * most), F.left(head, at.cast("int"))).otherwise(head)


def chunk_id(source: Column, doc_title: Column, suffix: Column, content: Column) -> Column:
    """Thirty-two hex digits of what names a chunk: source, title, kind and the first 200 characters."""
    return F.left(F.sha2(F.concat_ws("::", source, doc_title, suffix, F.left(content, F.lit(200))), 256), F.lit(32))


def match_count(haystack: Column, terms: Column) -> Column:
    """How many of the terms occur in a text, whatever the case."""
    low = F.lower(haystack)
    return F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))


def links(markdown: Column | str) -> Column:
    """Targets of links to pages, in order, distinct: Markdown links (no images), then raw anchors; no fragment, query or tooltip."""
    c = col(markdown)
    inline = F.regexp_extract_all(c, F.lit(r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))
    raw = F.regexp_extract_all(c, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))
    bare = F.transform(F.concat(inline, raw), lambda x: F.regexp_replace(x, r"[?#].*$", ""))
    return F.array_distinct(F.filter(bare, lambda x: x.rlike(r"(?i)\.(md|html?)$") & ~x.rlike(r"(?i)^([a-z][a-z0-9+.\-]*:|//)") & ~x.rlike(r"(?i)(^|/)assets/")))


def hrefs(html: Column | str) -> Column:
    """All link targets of an HTML page, in order, distinct, without fragment and query."""
    found = F.regexp_extract_all(col(html), F.lit(r"href=\"([^\"]*)\""), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"[?#].*$", "")), lambda x: x != ""))
