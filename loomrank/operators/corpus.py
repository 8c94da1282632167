"""The corpus: catalog rows with unit vectors, canonical cuts, pools, guards and ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vectors as V


def with_unit(df: DataFrame, vector: str, out: str = "unit") -> DataFrame:
    """Adds the unit vector; the length is a column of its own, so it is worked out once a row."""
    return df.withColumn("_v", V.as_doubles(F.col(vector))).withColumn("_n", V.norm(F.col("_v"))).withColumn(out, V.scaled(F.col("_v"), F.col("_n"))).drop("_v", "_n")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def canonical(corpus: DataFrame) -> DataFrame:
    """One eligible row a family: 400 normal, else 400, else the first by id."""
    preference = F.when((F.col("weight") == 400) & (F.col("style") == "normal"), 0).when(F.col("weight") == 400, 1).otherwise(2)
    return first_by(corpus.where("eligible"), ["family"], preference, F.col("id"))


def pick_cut(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (key, family, weight, style; the last two may be null) with the id of the named cut.

    An exact cut wins; without a style a normal one is preferred; else the canonical cut, with a warning.
    """
    w = wanted.select("key", F.col("family").alias("_f"), F.col("weight").alias("_w"), F.col("style").alias("_s"))
    both = w.join(corpus, w["_f"] == corpus["family"])
    named = F.coalesce(F.col("weight") == F.col("_w"), F.lit(True)) & F.coalesce(F.col("style") == F.col("_s"), F.lit(True)) & (F.col("_w").isNotNull() | F.col("_s").isNotNull())
    order = F.when(named & (F.col("_s").isNotNull() | (F.col("style") == "normal")), 0).when(named, 1).when((F.col("weight") == 400) & (F.col("style") == "normal"), 2).when(F.col("weight") == 400, 3).otherwise(4)
    best = first_by(both.withColumn("_order", order), ["key"], F.col("_order"), F.col("id"))
    return best.select("key", "family", "id", ((F.col("_order") > 1) & (F.col("_w").isNotNull() | F.col("_s").isNotNull())).alias("warned"))


def pool(heads: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every heading with every eligible row of another family; columns of headings start with ``h_``.

    Headings are one row a family; the planner broadcasts them where their size allows it.
    """
    h = heads.select(*[F.col(c).alias(f"h_{c}") for c in heads.columns])
    return h.join(corpus.where("eligible"), F.col("h_family") != F.col("family"))


def body_suitable(weight: Column) -> Column:
    return weight.between(K.BODY_MIN, K.BODY_MAX)


def stroke_guard(pairs: DataFrame, heading: str = "h_id") -> DataFrame:
    """Body candidates no heavier than their heading; a heading without any keeps its whole pool.

    Whether a heading has one is a partial aggregate, broadcast as one flag a heading.
    """
    some = pairs.groupBy(heading).agg(F.max(F.col("weight") <= F.col("h_weight")).alias("_any"))
    return pairs.join(F.broadcast(some), heading).where((F.col("weight") <= F.col("h_weight")) | ~F.col("_any")).drop("_any")


def role_guard(pairs: DataFrame, role: str, *guards: Column) -> DataFrame:
    """Guards hold for candidates of the body role alone; every other role keeps its pool."""
    for guard in guards if role == "body" else ():
        pairs = pairs.where(guard)
    return pairs


def expand_ladder(families: DataFrame) -> DataFrame:
    """Instances of (family, variable, low, high, weight, has_italic): a variable face at the ladder's weights within its axis."""
    steps = F.filter(F.array(*[F.lit(w) for w in K.LADDER]), lambda w: w.between(F.col("low"), F.col("high")))
    weights = F.when(F.col("variable"), F.when(F.size(steps) > 0, steps).otherwise(F.array(F.col("weight")))).otherwise(F.array(F.col("weight")))
    styles = F.when(F.col("has_italic"), F.array(F.lit("normal"), F.lit("italic"))).otherwise(F.array(F.lit("normal")))
    return families.select("family", F.explode(weights).alias("weight"), F.lit(None).alias("_"), styles.alias("_styles")).select("family", "weight", F.explode("_styles").alias("style"))


def pairing_eligible(subsets: Column, script: Column) -> Column:
    return F.array_contains(subsets, "latin") & ~F.coalesce(script, F.lit("")).isin(*K.CJK_SCRIPTS)


def served_only(instances: DataFrame, served: DataFrame) -> DataFrame:
    """Instances whose (family, weight, style) is served."""
    return instances.join(served, ["family", "weight", "style"], "left_semi")


def release_counts(families: DataFrame, served: DataFrame) -> DataFrame:
    """One row of a release's counts: families at hand, published and kept, families and cuts left out, instances and eligible ones.

    ``families`` has one row an instance (family, weight, style, eligible); ``served`` the published (family, weight, style).
    """
    marked = families.join(served.distinct().withColumn("_s", F.lit(True)), ["family", "weight", "style"], "left")
    some = F.col("_s").isNotNull()
    counts = marked.agg(
        F.countDistinct("family").alias("families"), F.countDistinct(F.when(some, F.col("family"))).alias("families_kept"), F.count_if(~some).alias("cuts_dropped"),
        F.count_if(some).alias("instances"), F.count_if(some & F.col("eligible")).alias("eligible"),
    )
    return counts.join(served.agg(F.countDistinct("family").alias("published"))).withColumn("unpublished", F.col("families") - F.col("families_kept")).select("families", "published", "families_kept", "unpublished", "cuts_dropped", "instances", "eligible")


def cross_check(local: DataFrame, published: DataFrame, key: str = "family") -> DataFrame:
    """(side, name): names of one table that the other lacks."""
    a, b = local.select(key).distinct(), published.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("local_only").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("published_only").alias("side"), key))


def merge(public: DataFrame, private: DataFrame) -> DataFrame:
    """Public rows, then private ones with ids moved behind them; ``integrity.unlike_dims`` tells beforehand whether their vectors fit."""
    base = public.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("_base"))
    moved = private.join(F.broadcast(base)).withColumn("id", F.col("id") + F.col("_base")).drop("_base")
    return public.withColumn("source", F.lit("google")).unionByName(moved.withColumn("source", F.lit("private")), allowMissingColumns=True)


def match_families(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(label, family) by normalized name: exact matches if any, else prefixes either way.

    Each side sends its whole names and all beginnings of its names; a whole name meets a beginning of the other
    side by an equi-join, so a name costs as many rows as it has characters.
    """
    from ..functions.text import plain

    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        whole = df.select(name).distinct().withColumn("_key", plain(F.col(name))).where("_key <> ''")
        beginnings = F.transform(F.sequence(F.lit(1), F.length("_key")), lambda n: F.substring(F.col("_key"), F.lit(1), n))
        return whole, whole.select(name, F.explode(beginnings).alias("_key"))

    (a, a_begins), (b, b_begins) = side(labels, "label"), side(corpus, "family")
    met = a.join(b_begins, "_key").select("label", "family").unionByName(b.join(a_begins, "_key").select("label", "family")).distinct()
    exact = a.join(b, "_key").select("label", "family")
    return exact.unionByName(met.join(exact.select("label").distinct(), "label", "left_anti"))
