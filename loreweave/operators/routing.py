"""Batches of queries: vocabularies, plans, expansion, symbol owners and routes, as columns and joins.

Vocabularies, scopes and versions are parameters; nothing here knows a product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.operators.mentions import mentions
from loreweave.sources.shared import stored

#: Fixed value: longer queries are about broad concepts.
BROAD_CHARS = 30
#: A symbol, a run of two or more capitalised words, a quoted phrase, a Markdown heading.
SYMBOL = r"(?U:\b)[A-Za-z_][A-Za-z0-9_.]*(?U:\b)"
CAPITALISED = r"[A-Z][a-zA-Z0-9_]*(?:\s+[A-Z][a-zA-Z0-9_]*)+"
QUOTED = '"([^"]+)"'
HEADING = r"(?m)^#{1,6}[ \t]+(.+)$"

Terms = Sequence[str]


def holds_any(query: Column, terms: Terms) -> Column:
    """Whether a query holds any of the terms, whatever the case; null: no."""
    low = F.lower(F.coalesce(query, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms], F.lit(False))


def first_label(query: Column, vocabularies: Sequence[tuple[str, Terms]], otherwise: Column | None = None) -> Column:
    """Label of the first vocabulary that a query holds a term of."""
    none = F.lit(None).cast("string")
    return F.coalesce(*[F.when(holds_any(query, terms), label) for label, terms in vocabularies], none if otherwise is None else otherwise)


def is_broad(query: Column, terms: Terms) -> Column:
    """A broad term in it, or longer than BROAD_CHARS; null: no."""
    return holds_any(query, terms) | (F.coalesce(F.length(query), F.lit(0)) > BROAD_CHARS)


def title_terms(query: Column, extra: Column | None = None) -> Column:
    """Terms to look for in titles: given ones, runs of capitalised words, quoted ones; lower case, distinct, two characters at least."""
    text = F.coalesce(query, F.lit(""))
    some = F.concat(*([] if extra is None else [F.coalesce(extra, F.array().cast("array<string>"))]), F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)), F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)))
    return F.filter(F.array_distinct(F.transform(some, F.lower)), lambda x: F.length(x) > 1)


# --- plans


@dataclass(frozen=True)
class PlanRules:
    """What a plan goes by.

    ecosystems: (label, terms), the first that fits. families: (label, ecosystem or
    None for any, terms), the first that fits. defaults: family of an ecosystem
    whose terms say none. versions: (ecosystem, (version, terms) in order): such
    queries are filtered. apart: families that are a filter of their own. vague:
    terms that name an ecosystem's software without a version. disabled: ecosystems
    whose queries are blocked. broad: terms of broad questions.
    """

    ecosystems: Sequence[tuple[str, Terms]]
    families: Sequence[tuple[str, str | None, Terms]] = ()
    defaults: Sequence[tuple[str, str]] = ()
    versions: Sequence[tuple[str, Sequence[tuple[str, Terms]]]] = ()
    apart: Terms = ()
    vague: Sequence[tuple[str, Terms]] = ()
    disabled: Terms = ()
    broad: Terms = ()
    ask: bool = True
    messages: dict[str, str] = field(default_factory=lambda: {"blocked": "This documentation is not enabled.", "ambiguous": "Which software version do you mean?"})


def compatible(entry_ecosystem: Column, entry_software: Column, ecosystem: Column, scope_software: Column, software_ecosystems: Sequence[tuple[str, str]]) -> Column:
    """Whether a glossary entry may expand a query: entries of another ecosystem or software than the query's don't; general ones do.

    Null columns: general entries, queries without ecosystem or scope.
    """
    home = F.coalesce(*[F.when(entry_software == s, e) for s, e in software_ecosystems], F.lit(None).cast("string"))
    named = F.coalesce(entry_software, F.lit("")) != ""
    other_scope = scope_software.isNotNull() & named & ~entry_software.eqNullSafe(scope_software)
    other_home = scope_software.isNull() & named & ecosystem.isNotNull() & ~home.eqNullSafe(ecosystem)
    other = ecosystem.isNotNull() & (F.coalesce(entry_ecosystem, F.lit("")) != "") & ~entry_ecosystem.eqNullSafe(ecosystem)
    return ~(other_scope | other_home | other)


def alike(glossary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(entry, last, n, terms, rows): glossary entries of equal rows as one, with their smallest and largest entry and how many glossary rows they have.

    rows: an entry's rows (columns, in order of them); terms: all of an entry's. Of
    entries that are alike, the first says where in the glossary's order what they
    bring comes first, the last where it comes last.
    """
    own = glossary.where("entry is not null").groupBy("entry").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    one = own.groupBy("rows").agg(F.min("entry").alias("first"), F.max("entry").alias("last"), (F.count("*") * F.size("rows")).alias("n"))
    terms = F.flatten(F.filter(F.transform("rows", lambda r: r["terms"]), lambda t: t.isNotNull()))
    return one.select(F.col("first").alias("entry"), "last", "n", terms.alias("terms"), "rows")


def expand_queries(queries: DataFrame, glossary: DataFrame) -> DataFrame:
    """(query, text, matched, expanded): a query with the expansions of the glossary entries that it mentions, in the glossary's order.

    glossary: (entry, terms, expansions).
    """
    kinds = stored(alike(glossary, ("expansions", "terms")), "glossary")
    found = mentions(queries, kinds).join(kinds.select("entry", "n", "rows"), "entry").groupBy("query").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("entry", "rows"))).alias("m"))
    all_ = F.array_distinct(F.flatten(F.transform(F.flatten(F.transform("m", lambda x: x["rows"])), lambda r: r["expansions"])))
    out = queries.join(found, "query", "left")
    return out.select("query", "text", F.coalesce("n", F.lit(0)).cast("int").alias("matched"), F.concat_ws(" ", "text", F.coalesce(all_, F.array().cast("array<string>"))).alias("expanded"))


def plan(queries: DataFrame, rules: PlanRules, glossary: DataFrame | None = None) -> DataFrame:
    """(query, ecosystem, family, filter_family, filter_software, blocked, ambiguous, message, broad, title_terms, expanded), a row for each of queries.

    queries: (query, text) and, if there is one, scope_software. glossary: (entry,
    terms, expansions, ecosystem, software, family): compatible entries that are
    mentioned expand the query, give title terms, and fill in an ecosystem and a
    family where the query names none (the last entry that has one). Null text
    counts as empty. Filters: filter_family for families apart, filter_software for
    a version (and what is common to all, ''), null for none.
    """
    text, eco = F.col("text"), F.col("ecosystem")
    scope = F.col("scope_software") if "scope_software" in queries.columns else F.lit(None).cast("string")
    software_ecosystems = [(v, e) for e, own in rules.versions for v, _ in own]
    from_scope = F.coalesce(*[F.when(scope == v, e) for v, e in software_ecosystems], F.lit(None).cast("string"))
    base = queries.withColumn("scope_software", scope).withColumn("ecosystem", F.coalesce(from_scope, first_label(text, rules.ecosystems)))
    family = F.coalesce(*[F.when(holds_any(text, terms) & (F.lit(True) if of is None else eco.eqNullSafe(F.lit(of))), label) for label, of, terms in rules.families], *[F.when(eco == e, label) for e, label in rules.defaults], F.lit(None).cast("string"))
    base = base.withColumn("family", family)
    if glossary is None:
        base = base.withColumns({"expansions": F.array().cast("array<string>"), "extra": F.array().cast("array<string>")})
    else:
        entries = glossary.select("entry", "terms", "expansions", F.col("ecosystem").alias("e_ecosystem"), F.col("software").alias("e_software"), F.col("family").alias("e_family"))
        kinds = stored(alike(entries, ("terms", "expansions", "e_ecosystem", "e_family", "e_software")), "glossary")
        met = mentions(queries, kinds).join(kinds.select("entry", "last", F.posexplode("rows").alias("nth", "row")), "entry").select("query", "entry", "last", "nth", "row.*")
        met = met.join(base.select("query", "ecosystem", "scope_software"), "query")
        met = met.where(compatible(F.col("e_ecosystem"), F.col("e_software"), eco, F.col("scope_software"), software_ecosystems))
        last = lambda name: F.max(F.when(F.col(name) != "", F.struct("last", "nth", name)))[name]
        ordered = met.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("entry", "nth", "terms", "expansions"))).alias("m"), last("e_ecosystem").alias("g_ecosystem"), last("e_family").alias("g_family"))
        told = ordered.select("query", F.array_distinct(F.flatten(F.transform("m", lambda x: x["expansions"]))).alias("expansions"), F.flatten(F.transform("m", lambda x: F.concat(x["expansions"], x["terms"]))).alias("extra"), "g_ecosystem", "g_family")
        base = base.join(told, "query", "left").withColumn("ecosystem", F.coalesce("ecosystem", "g_ecosystem"))
        base = base.withColumn("family", F.coalesce("family", F.when(eco.isNull() | F.col("g_ecosystem").isNull() | (eco == F.col("g_ecosystem")), F.col("g_family"))))
    version = F.coalesce(*[F.when((eco == e) & holds_any(text, terms), v) for e, own in rules.versions for v, terms in own], F.lit(None).cast("string"))
    filtered = eco.isin([e for e, _ in rules.versions]) if rules.versions else F.lit(False)
    apart = F.when(filtered & F.col("family").isin(list(rules.apart)), F.col("family")) if rules.apart else F.lit(None).cast("string")
    blocked = F.coalesce(eco.isin(list(rules.disabled)), F.lit(False)) if rules.disabled else F.lit(False)
    several = [e for e, own in rules.versions if len(own) > 1]
    vague = reduce(lambda a, b: a | b, [(eco == e) & holds_any(text, terms) for e, terms in rules.vague if e in several], F.lit(False))
    ambiguous = F.coalesce(F.lit(rules.ask) & F.col("scope_software").isNull() & vague & version.isNull(), F.lit(False))
    message = F.when(blocked, rules.messages["blocked"]).when(ambiguous, rules.messages["ambiguous"])
    return base.select(
        "query", "ecosystem", "family", apart.alias("filter_family"), F.when(filtered & apart.isNull() & version.isNotNull(), F.array(version, F.lit(""))).alias("filter_software"), blocked.alias("blocked"), ambiguous.alias("ambiguous"), message.alias("message"),
        is_broad(text, rules.broad).alias("broad"), title_terms(text, F.col("extra")).alias("title_terms"), F.concat_ws(" ", F.coalesce("text", F.lit("")), F.coalesce("expansions", F.array().cast("array<string>"))).alias("expanded"),
    )


# --- symbols and routes


def symbol_owners(docs: DataFrame, scope_col: str, title_col: str, text_col: str) -> DataFrame:
    """(symbol, name, scope, sources): symbols of titles and Markdown headings that one scope only has.

    docs: also source. symbol: in lower case; name: as the first source in order
    writes it. Rows without a scope take no part; null titles and texts are empty.
    """
    lines = F.concat(F.array(F.coalesce(title_col, F.lit(""))), F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(HEADING), F.lit(1)))
    found = docs.where(F.col(scope_col).isNotNull()).select(F.col(scope_col).alias("scope"), "source", F.posexplode(F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(SYMBOL), F.lit(0))).alias("pos", "name"))
    by_scope = found.groupBy(F.lower("name").alias("symbol"), "scope").agg(F.min(F.struct("source", "pos", "name")).alias("first"), F.array_sort(F.collect_set("source")).alias("sources"))
    return by_scope.groupBy("symbol").agg(F.min("scope").alias("scope"), F.max("scope").alias("other"), F.min("first").alias("first"), F.first("sources").alias("sources")).where(F.col("scope") == F.col("other")).select("symbol", F.col("first.name").alias("name"), "scope", "sources")


@dataclass(frozen=True)
class Scope:
    """A part of the corpus that answers by itself: its key, its platform, how it is called, and what in a query names it."""

    key: str
    platform: str
    label: str
    terms: tuple[str, ...] = ()


def route(queries: DataFrame, owners: DataFrame, scopes: Sequence[Scope], platforms: Sequence[tuple[str, Terms]] = ()) -> DataFrame:
    """(query, mode, scopes, correction, clarification), a row for each of queries (query, text).

    A query whose owned symbols all belong to one of the scopes goes there; if it
    names others, a correction says so. Else it goes to the scopes that it names.
    A platform that it names without a scope of it adds its one scope, or asks
    which. A query that names nothing goes to all, but asks where a platform has
    several. mode: direct, comparison (several scopes), clarification (none).
    platforms: (platform, terms). Null text: a query that names nothing.
    """
    text, keys = F.col("text"), [s.key for s in scopes]
    by_platform = {p: [s.key for s in scopes if s.platform == p] for p in dict.fromkeys(s.platform for s in scopes)}
    words = queries.select("query", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SYMBOL), F.lit(0))).alias("pos", "word")).withColumn("symbol", F.lower("word"))
    owned = words.join(owners.select("symbol", "name", "scope"), "symbol").groupBy("query").agg(F.min("scope").alias("owner"), F.max("scope").alias("last"), F.min(F.struct("pos", "name")).alias("first"))
    owned = owned.where(F.col("owner") == F.col("last")).where(F.col("owner").isin(keys)).select("query", "owner", F.col("first.name").alias("symbol"))
    pick = lambda flags: F.filter(F.array(*[F.when(on, F.lit(k)) for k, on in flags] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    named = pick([(s.key, holds_any(text, s.terms)) for s in scopes])
    asked = {p: holds_any(text, terms) for p, terms in platforms}
    without = {p: asked[p] & ~F.arrays_overlap(F.col("named"), F.array(*map(F.lit, by_platform.get(p, [])))) if by_platform.get(p) else asked[p] for p in asked}
    added = pick([(by_platform[p][0], without[p]) for p in asked if len(by_platform.get(p, [])) == 1])
    which = [F.when(without[p], f"Which software of {p} do you mean?") for p in asked if len(by_platform.get(p, [])) > 1]
    several = [p for p, own in by_platform.items() if len(own) > 1]
    unasked = "Which platform do you mean?" if several and len(by_platform) > 1 else f"Which software of {several[0]} do you mean?" if several else None
    out = queries.join(owned, "query", "left").withColumn("named", named)
    out = out.withColumn("all_named", F.array_distinct(F.concat("named", added))).withColumn("ask", F.coalesce(*which, F.lit(None).cast("string")))
    out = out.withColumn("ask", F.when(F.col("ask").isNull() & (F.size("all_named") == 0), F.lit(unasked).cast("string")).otherwise(F.col("ask"))).withColumn("ask", F.when(F.col("owner").isNull(), F.col("ask")))
    to = F.when(F.col("owner").isNotNull(), F.array("owner")).when(F.col("ask").isNotNull(), F.array().cast("array<string>")).when(F.size("all_named") > 0, F.col("all_named")).otherwise(F.array(*map(F.lit, keys)))
    home = F.coalesce(*[F.when(F.col("owner") == s.key, s.platform) for s in scopes])
    label = F.coalesce(*[F.when(F.col("owner") == s.key, s.label) for s in scopes])
    other_scope = (F.size("named") > 0) & ~F.array_contains("named", F.col("owner"))
    any_platform = reduce(lambda a, b: a | b, asked.values(), F.lit(False))
    own_platform = reduce(lambda a, b: a | b, [on & (home == p) for p, on in asked.items()], F.lit(False))
    correction = F.when(F.col("owner").isNotNull() & (other_scope | (any_platform & ~own_platform)), F.concat("symbol", F.lit(" belongs to "), label, F.lit(", so the answer comes from there.")))
    mode = F.when(F.col("ask").isNotNull(), "clarification").when(F.size("scopes") > 1, "comparison").otherwise("direct")
    return out.withColumn("scopes", to).select("query", mode.alias("mode"), "scopes", F.coalesce(correction, F.lit("")).alias("correction"), F.coalesce("ask", F.lit("")).alias("clarification"))


def branches(routes: DataFrame) -> DataFrame:
    """(query, scope, nth): a row for each scope of each route, in order; queries that ask have none.

    Retrieval keyed by (query, scope) keeps the branches apart and runs them side by side.
    """
    return routes.where("mode <> 'clarification'").select("query", F.posexplode("scopes").alias("nth", "scope")).select("query", "scope", "nth")


def grouped(results: DataFrame, by_scope: DataFrame) -> DataFrame:
    """(query, rank, ...): results of (query, scope, pos, ...) as one list, groups in the order of their branch."""
    at = Window.partitionBy("query").orderBy("nth", "pos")
    return results.join(by_scope, ["query", "scope"]).withColumn("rank", F.row_number().over(at)).drop("nth", "pos")
