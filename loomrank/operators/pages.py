"""Pair labels out of landed pages, stylesheets, script bundles and API records.

Every miner takes rows with a text and gives (page columns, heading, partner) rows of raw names; ``names.resolved``
turns them into families. Patterns are bounded, so a page costs time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The marks by which the pages tell a pair.
NUMBERED = r"^\d+\.\s*(.+?)\s*&\s*(.+)$"
TITLED = r"^\d+\s+[^:]+:\s*(.+?)\s*(?:&|\+)\s*(.+)$"
JOINED = r"^(?:\d+\.?\s*)?([A-Z][A-Za-z0-9 .'&-]{1,58}) \+ ([A-Z][A-Za-z0-9 .'&-]{1,58})$"
ROLE_ROW = r"<td><strong>([^<]+?) and ([^<]+?)</strong></td>\s*<td>([^<]*)</td>\s*<td>([^<]*)</td>"
STYLESHEET = r'href="(https://fonts\.googleapis\.com/css2\?[^"]+)"'
SPECIMEN = r'specimen/([^"<>]+)"[^>]*>([^<]+)</a>'
CARD_FAMILY = r"font-family:\s*'([^']+)'"
REGISTERED = r"""["']?([\w-]+)["']?:\{id:"[\w-]+",family:"([^"]+)\""""
ID_PAIR = r"""\{id:"[^"]+",headingFontId:"([^"]+)",bodyFontId:"([^"]+)\""""
NAME_PAIR = r"""\{heading:\\?"([^"\\]+)\\?",body:\\?"([^"\\]+)\\?\""""


def _explode(df: DataFrame, found: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(found))


def _keep(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if c != text]


def _pairs(df: DataFrame, keep: list[str], heading: Column, partner: Column) -> DataFrame:
    return df.select(*keep, F.trim(heading).alias("heading"), F.trim(partner).alias("partner")).where((F.col("heading") != "") & (F.col("partner") != ""))


def element_pairs(pages: DataFrame, text: str, tags: tuple[str, ...], pattern: str, room: int = 160) -> DataFrame:
    """Pairs in the plain text of elements: 'N. X & Y' and 'N label: X & Y' headings, 'X + Y' cells and list items."""
    names = "|".join(tags)
    inner = F.regexp_extract_all(text, F.lit(rf"(?s)<(?:{names})(?:\s[^>]*)?>(.{{0,{room}}}?)</(?:{names})>"), F.lit(1))
    rows = _explode(pages, inner, "_inner").withColumn("_plain", F.trim(T.strip_tags(F.col("_inner"))))
    rows = rows.where(F.col("_plain").rlike(pattern))
    return _pairs(rows, _keep(pages, text), F.regexp_extract("_plain", pattern, 1), F.regexp_extract("_plain", pattern, 2))


def stylesheet_pairs(pages: DataFrame, text: str) -> DataFrame:
    """Links to a stylesheet of exactly two families: the first is the heading's."""
    rows = _explode(pages, F.regexp_extract_all(text, F.lit(STYLESHEET), F.lit(1)), "_link").withColumn("_families", T.families_of_stylesheet(F.col("_link")))
    return _pairs(rows.where(F.size("_families") == 2), _keep(pages, text), F.col("_families")[0], F.col("_families")[1])


def role_pairs(pages: DataFrame, text: str) -> DataFrame:
    """Table rows 'X and Y' whose last cell names both roles: the role named first is that of X."""
    row = lambda g: F.regexp_extract_all(text, F.lit(ROLE_ROW), F.lit(g))
    rows = _explode(pages, F.arrays_zip(row(1).alias("x"), row(2).alias("y"), row(4).alias("roles")), "_row")
    at = lambda role: F.instr(F.col("_row.roles"), role)
    rows = rows.where((at("Headings") > 0) & (at("Body Text") > 0)).withColumn("_first", at("Headings") < at("Body Text"))
    return _pairs(rows, _keep(pages, text), F.when(F.col("_first"), F.col("_row.x")).otherwise(F.col("_row.y")), F.when(F.col("_first"), F.col("_row.y")).otherwise(F.col("_row.x")))


def card_pairs(pages: DataFrame, text: str, card: str, family: str = CARD_FAMILY, group: int = 1) -> DataFrame:
    """The first two families of every card of a page, a card being what the pattern finds."""
    rows = _explode(pages, F.regexp_extract_all(text, F.lit(card), F.lit(0)), "_card").withColumn("_families", F.regexp_extract_all("_card", F.lit(family), F.lit(group)))
    return _pairs(rows.where(F.size("_families") >= 2), _keep(pages, text), F.col("_families")[0], F.col("_families")[1])


def rule_pairs(sheets: DataFrame, text: str, first: str = "firstfont", second: str = "secondfont") -> DataFrame:
    """Scoped rules of a stylesheet: the families that one scope (#day) gives its first and second class.

    Where a scope has several rules for a class the first one counts.
    """
    keep = _keep(sheets, text)

    def rules(kind: str, out: str) -> DataFrame:
        rule = lambda g: F.regexp_extract_all(text, F.lit(rf"#([a-z]+)\s+\.{kind}\s*\{{[^}}]*?font-family:\s*([^;}}]+)"), F.lit(g))
        rows = sheets.select(*keep, F.posexplode(F.arrays_zip(rule(1).alias("scope"), rule(2).alias("families"))).alias("_at", "_rule"))
        named = F.trim(F.translate(F.split("_rule.families", ",")[0], "\"'", ""))
        return rows.groupBy(*keep, F.col("_rule.scope").alias("scope")).agg(F.min_by(named, "_at").alias(out))

    return rules(first, "heading").join(rules(second, "partner"), [*keep, "scope"]).where("heading <> '' and partner <> ''").select(*keep, "heading", "partner")


def registry_pairs(bundles: DataFrame, text: str) -> DataFrame:
    """Pairs of ids in a script bundle, by the bundle's own registry of ids; ids that it lacks give no pair."""
    keep = _keep(bundles, text)
    found = lambda pattern, g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    registry = bundles.select(*keep, F.posexplode(F.arrays_zip(found(REGISTERED, 1).alias("id"), found(REGISTERED, 2).alias("family"))).alias("_at", "_r"))
    registry = registry.groupBy(*keep, F.col("_r.id").alias("id")).agg(F.max_by("_r.family", "_at").alias("family"))  # a later entry replaces an earlier one
    pairs = bundles.select(*keep, F.explode(F.arrays_zip(found(ID_PAIR, 1).alias("h"), found(ID_PAIR, 2).alias("p"))).alias("_p")).select(*keep, "_p.h", "_p.p")
    side = lambda key, out: registry.select(*keep, F.col("id").alias(key), F.col("family").alias(out))
    return pairs.join(side("h", "heading"), [*keep, "h"]).join(side("p", "partner"), [*keep, "p"]).select(*keep, "heading", "partner")


def bundle_pairs(bundles: DataFrame, text: str) -> DataFrame:
    """Pairs of names in a script bundle's objects with a heading and a body, quotes escaped or not."""
    found = lambda g: F.regexp_extract_all(text, F.lit(NAME_PAIR), F.lit(g))
    rows = _explode(bundles, F.arrays_zip(found(1).alias("h"), found(2).alias("p")), "_p")
    return _pairs(rows, _keep(bundles, text), F.col("_p.h"), F.col("_p.p"))


def api_pairs(records: DataFrame, text: str, array: str = "results", heading: str = "heading_font_family", partner: str = "body_font_family") -> DataFrame:
    """Pairs of a JSON answer's array of records."""
    schema = f"struct<{array}: array<struct<{heading}: string, {partner}: string>>>"
    rows = _explode(records, F.from_json(text, schema)[array], "_r")
    return _pairs(rows.where(F.col(f"_r.{heading}").isNotNull() & F.col(f"_r.{partner}").isNotNull()), _keep(records, text), F.col(f"_r.{heading}"), F.col(f"_r.{partner}"))


def keyed_pairs(pairs: DataFrame, fonts: DataFrame, kind: str = "google") -> DataFrame:
    """(heading, partner, tag) of pairs of font ids whose fonts are both of a kind; ``fonts`` has (id, name, kind).

    ``pairs`` has (heading_id, body_id, community): submissions of users carry a tag of their own.
    """
    own = fonts.where(F.col("kind") == kind)
    side = lambda key, out: own.select(F.col("id").alias(key), F.col("name").alias(out))
    met = pairs.join(side("heading_id", "heading"), "heading_id").join(side("body_id", "partner"), "body_id")
    return met.select("heading", "partner", F.when(F.coalesce("community", F.lit(False)), "community").otherwise("curated").alias("tag"))
