"""Scores and ranks of (heading, candidate) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vectors as V


def with_products(pairs: DataFrame) -> DataFrame:
    """Adds m (elementwise products), p, n (agreeing and opposing parts), cos and contrast; m is made once a pair."""
    df = pairs.withColumn("m", V.products(F.col("h_unit"), F.col("unit")))
    df = df.withColumns({"p": V.positive_part(F.col("m")), "n": V.negative_part(F.col("m")), "cos": V.total(F.col("m"))})
    return df.withColumn("contrast", F.col("p") * F.col("n")).drop("m")


def max_contrasts(pairs: DataFrame) -> DataFrame:
    """(h_id, cmax): largest contrast of each heading, 1 if there is none. A partial aggregate: no heading's pool meets in one task."""
    top = F.max("contrast")
    return pairs.groupBy("h_id").agg(F.when(top > 0, top).otherwise(F.lit(1.0)).alias("cmax"))


def max_contrast(pairs: DataFrame) -> DataFrame:
    """One row: the largest contrast of all pairs, 1 if there is none."""
    top = F.max("contrast")
    return pairs.agg(F.when(top > 0, top).otherwise(F.lit(1.0)).alias("cmax"))


def with_role_terms(pairs: DataFrame) -> DataFrame:
    """Adds the terms of the role score: cmax, cn, serif_split, gate, xh_match, width_match, leg.

    The headings' maxima are broadcast: two numbers a heading, and headings are one row a family.
    """
    df = pairs.join(F.broadcast(max_contrasts(pairs)), "h_id").withColumn("cn", F.col("contrast") / F.col("cmax"))
    return df.withColumns(
        {
            "serif_split": F.when(F.col("h_serif") != F.col("serif"), 1.0).otherwise(0.0),
            "gate": V.gate(F.col("h_xh"), F.col("xh")),
            "xh_match": V.match(F.col("h_xh"), F.col("xh"), K.XH_SPAN),
            "width_match": V.match(F.col("h_width"), F.col("width"), K.WIDTH_SPAN),
            "leg": F.coalesce(F.col("legibility"), F.lit(0.5)),
        }
    )


def pair_score(t: float = 0.0) -> Column:
    """Contrast relative to the heading's largest, less t times the cosine."""
    return F.col("cn") - t * F.col("cos")


def role_score(role: str, t: float = 0.0) -> Column:
    score = pair_score(t) + K.SERIF_BONUS * F.col("serif_split") * F.col("gate") + K.XH_WEIGHT * F.col("xh_match") + K.WIDTH_WEIGHT * F.col("width_match")
    return score + K.BODY_LEGIBILITY * F.col("leg") if role == "body" else score


def hand_score() -> Column:
    return F.col("cn") + 0.5 * F.coalesce(F.col("legibility"), F.lit(0.0)) + 0.2 * F.col("serif_split") * F.col("gate")


def ranked(pairs: DataFrame, score: str, by: tuple[str, ...] = ("h_id",), tie: str = "id", out: str = "rank") -> DataFrame:
    return pairs.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))))


def best_cut_per_family(pairs: DataFrame, score: str) -> DataFrame:
    """(h_id, family, score) of each family's best cut, for ranking families."""
    return pairs.groupBy("h_id", "h_family", "family").agg(F.max(score).alias(score))


def swept(pairs: DataFrame, candidates: dict[str, Column], by: tuple[str, ...] = ("h_id",)) -> DataFrame:
    """One row a (pair, candidate score), ranked within candidate and heading; the corpus is scanned once."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("candidate"), score.alias("score")) for name, score in candidates.items()]))
    return ranked(pairs.withColumn("_c", rows).select("*", "_c.candidate", "_c.score").drop("_c"), "score", ("candidate", *by))


def feature_frame(pairs: DataFrame) -> DataFrame:
    """The ten static features of the learned ranker."""
    return pairs.withColumns(
        {
            "f_cos": F.col("cos"), "f_contrast": F.col("cn"), "f_leg_body": F.coalesce(F.col("legibility"), F.lit(0.0)), "f_leg_head": F.coalesce(F.col("h_legibility"), F.lit(0.0)),
            "f_serif_split": F.col("serif_split"), "f_serif_skel": F.col("serif_split") * F.col("gate"), "f_dxh": F.coalesce(-F.abs(F.col("h_xh") - F.col("xh")), F.lit(-1.0)),
            "f_bodyweight": V.lightness(F.col("weight")), "f_italic": F.when(F.col("style") == "italic", 1.0).otherwise(0.0), "f_concentration": V.concentration(F.col("h_unit"), F.col("unit")),
        }
    )


STATIC_FEATURES = ("f_cos", "f_contrast", "f_leg_body", "f_leg_head", "f_serif_split", "f_serif_skel", "f_dxh", "f_bodyweight", "f_italic", "f_concentration")


def learned_score(weights: dict[str, float], bias: float) -> Column:
    return sum((F.col(f) * w for f, w in weights.items()), F.lit(bias))


#: the ten features and the two of the pair graph
ALL_FEATURES = (*STATIC_FEATURES, "f_dsknn", "f_has_graph")
