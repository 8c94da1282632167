"""Retrieval metrics, medians, diffs and significance over ranked pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running_before
from .stages import kept


def partner_ranks(ranked: DataFrame, partners: DataFrame, missing: bool = True) -> DataFrame:
    """(h_id, partner, rank, pool): rank of each labelled partner id; one that isn't ranked gets pool + 1."""
    pools = ranked.groupBy("h_id").agg(F.count("*").alias("pool"))
    at = ranked.select("h_id", F.col("id").alias("partner"), "rank")
    out = partners.join(at, ["h_id", "partner"], "left").join(pools, "h_id")
    return out.withColumn("rank", F.coalesce("rank", F.col("pool") + 1)) if missing else out.where("rank is not null")


def per_heading(ranks: DataFrame, k: int) -> DataFrame:
    """(h_id, n, best, hits, dcg, idcg) of each heading."""
    gain = lambda p: 1.0 / F.log2(p + 1.0)
    df = ranks.groupBy("h_id").agg(
        F.count("*").alias("n"), F.min("rank").alias("best"), F.count_if(F.col("rank") <= k).alias("hits"),
        F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.col("rank")))).alias("_at"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, p: a + gain(p))
    return df.withColumns({"dcg": F.aggregate("_at", F.lit(0.0), lambda a, p: a + gain(p)), "idcg": ideal}).drop("_at")


def upper_median(df: DataFrame, value: str) -> float | None:
    """The value at place floor(n / 2) of the sorted values; null ones don't count. Found by ranges, not in one task."""
    some = df.where(F.col(value).isNotNull()).select(value)
    n = some.count()
    return running_before(some, value, out="_at").where(F.col("_at") <= n // 2).agg(F.max(value)).first()[0] if n else None


def true_median(x: str) -> Column:
    return F.percentile(x, F.lit(0.5)).cast("int")


def summary(headings: DataFrame, k: int, medians: bool = True) -> DataFrame:
    """Counts, recall and nDCG over per-heading rows, and the two medians of the best rank where they are asked for.

    The medians take several steps, so the rows (one a heading) are written once for them.
    """
    headings = kept(headings) if medians else headings
    figures = headings.agg(
        F.count("*").alias("headings"), F.count_if(F.col("best") <= k).alias("hit"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"),
        F.round(F.avg(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"), *([true_median("best").alias("median_true")] if medians else []),
    )
    return figures.withColumn("median_upper", F.lit(upper_median(headings, "best")).cast("int")) if medians else figures


def role_summary(headings: DataFrame) -> DataFrame:
    """(role, headings, recall, ndcg) of per-heading rows with a role, and one row of their mean over roles (role null)."""
    each = headings.groupBy("role").agg(F.count("*").alias("headings"), F.avg(F.col("hits") / F.col("n")).alias("recall"), F.avg(F.col("dcg") / F.col("idcg")).alias("ndcg"))
    mean = each.agg(F.lit(None).cast("string").alias("role"), F.sum("headings").alias("headings"), F.avg("recall").alias("recall"), F.avg("ndcg").alias("ndcg"))
    return each.unionByName(mean)


def ranks_by_count(scores: DataFrame, partners: DataFrame) -> DataFrame:
    """(h_id, partner, rank, pool): 1 and the number of candidates that stand before each labelled partner id.

    ``scores`` has (h_id, id, score). Nothing is sorted and no heading's pool meets in one task: a candidate is
    counted against its heading's few partners where it lies. One that isn't a candidate gets pool + 1.
    """
    at = scores.select("h_id", F.col("id").alias("partner"), F.col("score").alias("_score"))
    wanted = partners.select("h_id", "partner").distinct().join(at, ["h_id", "partner"], "left")
    own = wanted.groupBy("h_id").agg(F.collect_list(F.struct("partner", "_score")).alias("_partners"))
    before = (F.col("score") > F.col("_p._score")) | ((F.col("score") == F.col("_p._score")) & (F.col("id") < F.col("_p.partner"))) | F.col("_p._score").isNull()
    met = scores.select("h_id", "id", "score").join(own, "h_id").select("h_id", "id", "score", F.explode("_partners").alias("_p"))
    return met.groupBy("h_id", F.col("_p.partner").alias("partner")).agg((F.count_if(before) + 1).alias("rank"), F.count("*").alias("pool"))


def breaks_and_fixes(baseline: DataFrame, candidate: DataFrame, k: int) -> DataFrame:
    """(h_id, change) of headings that pass one ranking at k and fail the other."""
    b = baseline.select("h_id", (F.col("best") <= k).alias("_b"))
    c = candidate.select("h_id", (F.col("best") <= k).alias("_c"))
    return b.join(c, "h_id", "full").where(F.coalesce("_b", F.lit(False)) != F.coalesce("_c", F.lit(False))).select("h_id", F.when(F.coalesce("_b", F.lit(False)), "break").otherwise("fix").alias("change"))


def folds(headings: DataFrame, order: str = "h_id", parts: int = 2) -> DataFrame:
    """Even and odd headings by position."""
    return running_before(headings, order, out="_at").withColumn("fold", F.col("_at") % parts).drop("_at")


def z_and_auc(scores: DataFrame) -> DataFrame:
    """z of the mean and the exact AUC of real (label 1) against null (label 0) scores, ties counted half."""
    ordered = scores.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("r"), F.count_if(F.col("label") == 0).alias("m"))
    placed = running_before(ordered, "score", amount=F.col("m"), out="below")
    wins = placed.agg(F.sum(F.col("r") * (F.col("below") + F.col("m") / 2)).alias("w"))
    stats = scores.agg(F.count_if(F.col("label") == 1).alias("real"), F.count_if(F.col("label") == 0).alias("nulls"), F.avg(F.expr("case when label = 1 then score end")).alias("rm"), F.avg(F.expr("case when label = 0 then score end")).alias("nm"), F.stddev_pop(F.expr("case when label = 0 then score end")).alias("sd"))
    return stats.join(F.broadcast(wins)).select("real", "nulls", F.round((F.col("rm") - F.col("nm")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0), 6).alias("z"), F.round(F.col("w") / (F.col("real") * F.col("nulls")), 6).alias("auc"))


def percentile(better, total):
    """Share of what a reference beats, in percent."""
    return 100.0 * (1.0 - better / total)


def seed_summary(results: DataFrame) -> DataFrame:
    """Mean and range over seeds of (metric, seed, value)."""
    return results.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))


def rank_normalized(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """(rank - 1) / max(n - 1, 1); ties by order, not averaged. Missing values stay missing."""
    some, none = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
    n = some.count()
    placed = running_before(some, value, tie, out="_before").withColumn(out, F.col("_before") / F.lit(float(max(n - 1, 1)))).drop("_before")
    return placed.unionByName(none.withColumn(out, F.lit(None).cast("double")))


def evenly_spaced(df: DataFrame, order: str, k: int) -> DataFrame:
    """k rows at positions int(i * n / k)."""
    n = df.count()
    wanted = sorted({int(i * n / k) for i in range(k)}) if n else []
    return running_before(df, order, out="_at").where(F.col("_at").isin(*wanted) if wanted else F.lit(False)).drop("_at")
