"""Joint choice of a body and an accent for each heading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vectors as V
from .evaluate import percentile


def top_of(pairs: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("h_id").orderBy(F.desc(score), "id")
    return pairs.withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= k)


def triples(bodies: DataFrame, accents: DataFrame) -> DataFrame:
    """Every (heading, body, accent) of a heading's two short lists with three families; cut sizes bound it."""
    b = bodies.select("h_id", F.col("id").alias("b_id"), F.col("family").alias("b_family"), F.col("unit").alias("b_unit"), V.concentration(F.col("h_unit"), F.col("unit")).alias("concentration"), F.col("cn").alias("hb"), F.col("leg").alias("b_leg"), F.col("ord").alias("b_ord"), F.col("category").alias("b_category"), "h_category")
    a = accents.select("h_id", F.col("id").alias("a_id"), F.col("family").alias("a_family"), F.col("unit").alias("a_unit"), F.col("cn").alias("ha"), F.col("ord").alias("a_ord"), F.col("category").alias("a_category"), "cmax")
    both = b.join(a, "h_id").where(F.col("b_family") != F.col("a_family"))
    return both.withColumn("_m", V.products(F.col("b_unit"), F.col("a_unit"))).withColumn("ba", V.contrast(F.col("_m")) / F.col("cmax")).drop("_m", "b_unit", "a_unit")


def objective(agg: str = "min", beta: float = K.TRIPLE_LEGIBILITY):
    """Least, sum or product of the three contrasts, and ``beta`` times the body's legibility."""
    parts = ("hb", "ha", "ba")
    joined = {"min": F.least(*parts), "sum": F.col("hb") + F.col("ha") + F.col("ba"), "product": F.col("hb") * F.col("ha") * F.col("ba")}[agg]
    return joined + beta * F.col("b_leg")


def best_triple(found: DataFrame, agg: str = "min") -> DataFrame:
    """The triple of the largest objective of each heading; the first in list order wins ties."""
    scored = found.withColumn("objective", objective(agg))
    order = Window.partitionBy("h_id").orderBy(F.desc("objective"), "b_ord", "a_ord")
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def triples_above(found: DataFrame, reference: DataFrame, legible: float | None = None) -> DataFrame:
    """Per heading: how many triples score above the reference objective, their number, and the reference's percentile.

    With ``legible`` only triples whose body reaches that legibility count.
    """
    rows = found if legible is None else found.where(F.col("b_leg") >= legible)
    scored = rows.withColumn("objective", objective()).join(F.broadcast(reference.select("h_id", F.col("objective").alias("_ref"))), "h_id")
    counts = scored.groupBy("h_id").agg(F.count_if(F.col("objective") > F.col("_ref")).alias("better"), F.count("*").alias("total"))
    return counts.withColumn("percentile", percentile(F.col("better"), F.col("total")))


def exhaustive(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """(h_id, better, total): (body, accent) pairs of other families whose summed contrast with the heading passes the reference's, and all such pairs.

    Counted over all candidates without making the pairs: with scores in order, the partners above a threshold
    of every body are a running count, less those of the body's own family. Scores are compared in whole
    billionths, so that sums are exact.
    """
    whole = lambda c: F.round(F.col(c) * 1e9).cast("long")
    own = pairs.select("h_id", "family", whole("cn").alias("s"))
    ref = F.broadcast(reference.select("h_id", whole("objective").alias("_ref")))
    # a pair passes where s(accent) > ref - s(body): both kinds of rows in one order, accents after equal thresholds
    marks = own.join(ref, "h_id").select("h_id", "family", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("accent")), F.struct((F.col("_ref") - F.col("s")).alias("at"), F.lit(0).alias("accent")))).alias("m")).select("h_id", "family", "m.*")

    def above(keys: list[str]) -> DataFrame:
        ahead = F.sum("accent").over(Window.partitionBy(*keys).orderBy(F.desc("at"), "accent").rowsBetween(Window.unboundedPreceding, -1))
        return marks.withColumn("_n", F.coalesce(ahead, F.lit(0))).where("accent = 0").groupBy("h_id").agg(F.sum("_n").alias("n"))

    sizes = own.groupBy("h_id", "family").agg(F.count("*").alias("c")).groupBy("h_id").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("total"))
    inside = above(["h_id", "family"]).withColumnRenamed("n", "_in")
    return above(["h_id"]).join(inside, "h_id").join(sizes, "h_id").select("h_id", (F.col("n") - F.col("_in")).alias("better"), "total")


def engine_metrics(best: DataFrame) -> DataFrame:
    """Mean legibility, contrast sum, balance (least over greatest contrast), concentration of heading and body, and number of categories."""
    spread = F.size(F.array_distinct(F.array("h_category", "b_category", "a_category")))
    low, high = F.least("hb", "ha", "ba"), F.greatest("hb", "ha", "ba")
    return best.agg(
        F.count("*").alias("headings"), F.round(F.avg("b_leg"), 6).alias("legibility"), F.round(F.avg(F.col("hb") + F.col("ha") + F.col("ba")), 6).alias("contrast"),
        F.round(F.avg(low / F.when(high > 0, high).otherwise(1.0)), 6).alias("balance"), F.round(F.avg("concentration"), 6).alias("concentration"),
        F.round(F.avg(spread), 6).alias("spread"), F.round(F.avg(F.when(F.col("b_leg") >= 0.5, 1.0).otherwise(0.0)), 6).alias("legible_rate"),
    )


def recommendation_overlap(one: DataFrame, other: DataFrame, k: int = 4) -> DataFrame:
    """Per heading: how many of the first k two rankings share, and whether the order differs."""
    lists = lambda d, out: d.where(F.col("rank") <= k).groupBy("h_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(out))
    return lists(one, "x").join(lists(other, "y"), "h_id").select("h_id", F.size(F.array_intersect("x", "y")).alias("shared"), (F.col("x") != F.col("y")).alias("reordered"))


def crowding(ranked: DataFrame, k: int) -> DataFrame:
    """Per heading: largest share of one family in the first k, and the share of another category."""
    top = ranked.where(F.col("rank") <= k)
    most = top.groupBy("h_id", "family").agg(F.count("*").alias("_n")).groupBy("h_id").agg((F.max("_n") / F.sum("_n")).alias("crowding"))
    other = top.groupBy("h_id").agg(F.avg(F.when(F.col("category") != F.col("h_category"), 1.0).otherwise(0.0)).alias("other_category"))
    return most.join(other, "h_id")
