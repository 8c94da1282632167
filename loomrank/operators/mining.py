"""Pair labels from co-occurrence and from named lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import js_round


def multi_rows(items: DataFrame, row: str, name: str) -> DataFrame:
    """Distinct (row, name) of rows with two names or more."""
    sets = items.select(row, name).distinct()
    many = sets.groupBy(row).agg(F.count("*").alias("_n")).where("_n >= 2")
    return sets.join(many.drop("_n"), row, "left_semi")


def support(sets: DataFrame, name: str) -> DataFrame:
    return sets.groupBy(name).agg(F.count("*").alias("support"))


def pair_rows(sets: DataFrame, row: str, name: str, *carry: str) -> DataFrame:
    """(row, a, b) with a < b of every two names of a row, made within the row; rows hold few names."""
    lists = sets.groupBy(row, *carry).agg(F.array_sort(F.collect_set(name)).alias("_names"))
    at = F.sequence(F.lit(1), F.size("_names") - 1)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.slice("_names", i + 1, F.size("_names")), lambda b: F.struct(F.element_at("_names", i).alias("a"), b.alias("b")))))
    return lists.where(F.size("_names") >= 2).select(row, *carry, F.explode(pairs).alias("_p")).select(row, *carry, "_p.a", "_p.b")


def uses(pairs: DataFrame, medium: str | None = None) -> DataFrame:
    """(a, b, uses[, mediums map]) of pair rows."""
    if medium is None:
        return pairs.groupBy("a", "b").agg(F.count("*").alias("uses"))
    each = pairs.groupBy("a", "b", medium).agg(F.count("*").alias("_n"))
    return each.groupBy("a", "b").agg(F.sum("_n").alias("uses"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(medium, "_n")))).alias("mediums"))


def lift(counted: DataFrame, supports: DataFrame, name: str, rows: int) -> DataFrame:
    """uses * N / (support a * support b), a missing support counting as 1; rounded to two digits, halves up."""
    a = supports.select(F.col(name).alias("a"), F.col("support").alias("_sa"))
    b = supports.select(F.col(name).alias("b"), F.col("support").alias("_sb"))
    df = counted.join(a, "a", "left").join(b, "b", "left")
    value = F.col("uses") * float(rows) / (F.coalesce("_sa", F.lit(1)) * F.coalesce("_sb", F.lit(1)))
    return df.withColumn("lift", js_round(value, 2)).drop("_sa", "_sb")


def symmetric(pairs: DataFrame) -> DataFrame:
    """Each unordered pair both ways, as (heading, partner)."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    one = pairs.select(F.col("a").alias("heading"), F.col("b").alias("partner"), *rest)
    return one.unionByName(pairs.select(F.col("b").alias("heading"), F.col("a").alias("partner"), *rest))


def grouped(labels: DataFrame, least: int = 2) -> DataFrame:
    """(heading, partners array of (family, sources)) of headings with ``least`` partners or more."""
    each = labels.groupBy("heading", "partner").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    nested = each.groupBy("heading").agg(F.array_sort(F.collect_list(F.struct(F.col("partner").alias("family"), "sources"))).alias("partners"))
    return nested.where(F.size("partners") >= least)


def source_yield(labels: DataFrame) -> DataFrame:
    """(source, pairs, added): a pair counts as added by its first source in source order."""
    firsts = labels.groupBy("heading", "partner").agg(F.min_by("source", "source_order").alias("source")).groupBy("source").agg(F.count("*").alias("added"))
    return labels.groupBy("source").agg(F.countDistinct("heading", "partner").alias("pairs")).join(firsts, "source", "left").fillna(0, ["added"])


def unresolved(names: DataFrame, known: DataFrame, k: int = 25) -> DataFrame:
    """The k most frequent names that no family has."""
    return names.join(known, "name", "left_anti").groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k)


def union_graph(*labels: DataFrame) -> DataFrame:
    """(heading, partners) over several edge tables, self edges left out."""
    edges = labels[0].select("heading", "partner")
    for more in labels[1:]:
        edges = edges.unionByName(more.select("heading", "partner"))
    return edges.where("heading <> partner").distinct().groupBy("heading").agg(F.array_sort(F.collect_list("partner")).alias("partners"))


def refined(pairs: DataFrame, least_uses: int = 2, least_lift: float = 2.0) -> DataFrame:
    return pairs.where((F.col("uses") >= least_uses) & (F.col("lift") >= least_lift) & ~F.coalesce("kin", F.lit(False)))


def in_mediums(pairs: DataFrame, mediums: tuple[str, ...]) -> DataFrame:
    return pairs.where(F.arrays_overlap(F.map_keys("mediums"), F.array(*[F.lit(m) for m in mediums])))


def resolve_labels(labels: DataFrame, dropped: DataFrame, matches: DataFrame, same_family: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, missing): owner labels with dropped pairs and headings removed and names resolved.

    ``dropped`` has (heading, partner or null for the whole heading); ``matches`` has (label, family). The
    first family of a heading and all families of a partner are kept.
    """
    whole = dropped.where("partner is null").select("heading")
    single = dropped.where("partner is not null").select("heading", "partner")
    kept = labels.join(whole, "heading", "left_anti").join(single, ["heading", "partner"], "left_anti")
    heads = matches.groupBy("label").agg(F.min("family").alias("h_family")).withColumnRenamed("label", "heading")
    partners = matches.select(F.col("label").alias("partner"), F.col("family").alias("p_family"))
    edges = kept.join(heads, "heading").join(partners, "partner").select("h_family", "p_family").distinct()
    names = kept.select(F.col("heading").alias("label")).unionByName(kept.select(F.col("partner").alias("label"))).distinct()
    return edges if same_family else edges.where("h_family <> p_family"), names.join(matches, "label", "left_anti")
