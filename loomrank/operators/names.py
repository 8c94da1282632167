"""Raw names to families: renames, spellings, cuts at the end of a name, and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T


def aliases(spark, renamed: dict[str, str]) -> DataFrame:
    """(alias, alias_family); the dictionaries of renames are of fixed size."""
    return spark.createDataFrame(list(renamed.items()) or [("", "")], "alias string, alias_family string")


def resolved(names: DataFrame, known: DataFrame, renamed: dict[str, str] | None = None, usage: bool = False) -> DataFrame:
    """(name, family) of every name that some family has; ``known`` has (family).

    A cleaned name is tried whole, then without its last word as long as that names a cut. Each try looks for
    a rename, for the family's exact spelling and for any spelling in upper and lower case, in this order; the
    first try that finds one wins. Records of use (``usage``) differ: what stands in parentheses is left out,
    spellings come before renames, renames are read without case and count only where the family is known.
    """
    spark = names.sparkSession
    table = aliases(spark, (K.STAND_INS if usage else K.RENAMED) if renamed is None else renamed)
    clean = names.select("name").distinct().withColumn("_clean", T.cleaned_name(F.col("name"), parentheses=not usage)).where("_clean <> ''")
    tries = clean.select("name", F.posexplode(T.prefixes_without_qualifiers(F.col("_clean"))).alias("at", "try"))
    families = known.select("family").distinct()
    loose = families.groupBy(F.lower("family").alias("_low")).agg(F.min("family").alias("_loose"))
    hits = tries.join(families.select(F.col("family").alias("_exact")), F.col("try") == F.col("_exact"), "left").join(loose, F.lower("try") == F.col("_low"), "left")
    hits = hits.join(F.broadcast(table), (F.lower("try") if usage else F.col("try")) == F.col("alias"), "left")
    if usage:
        hits = hits.join(families.select(F.col("family").alias("_there")), F.col("alias_family") == F.col("_there"), "left")
        found = F.coalesce("_exact", "_loose", "_there")
    else:
        found = F.coalesce("alias_family", "_exact", "_loose")
    return hits.withColumn("family", found).where("family is not null").groupBy("name").agg(F.min_by("family", "at").alias("family"))


def nearest_families(labels: DataFrame, known: DataFrame, k: int = 4) -> DataFrame:
    """(label, families): the first k by name of the families that hold the first four plain characters of a label.

    Names meet on the pieces of up to four characters of a family's plain name, so no label is compared with all.
    """
    keys = labels.select("label").distinct().withColumn("_key", F.substring(T.plain(F.col("label")), 1, 4)).where("_key <> ''")
    named = known.select("family").distinct().withColumn("_plain", T.plain(F.col("family"))).where("_plain <> ''")
    sizes = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.length("_plain")), lambda i: F.substring(F.col("_plain"), i, n))))
    pieces = named.select("family", F.explode(F.array_distinct(sizes)).alias("_key"))
    return keys.join(pieces, "_key").groupBy("label").agg(F.slice(F.array_sort(F.collect_set("family")), 1, k).alias("families"))


def source_counts(labels: DataFrame) -> DataFrame:
    """(source, labels, families): labels of each source and its distinct families in order."""
    return labels.groupBy("source").agg(F.count("*").alias("labels"), F.array_sort(F.collect_set("family")).alias("families"))


def instance_order(instances: DataFrame, *ties: str) -> DataFrame:
    """Instances by lower-case family, weight and style, as a corpus numbers them, then by the columns ``ties``; nulls come last."""
    return instances.orderBy(*(c.asc_nulls_last() for c in (F.lower("family"), *map(F.col, ("weight", "style", *ties)))))
