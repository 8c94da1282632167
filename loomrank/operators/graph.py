"""The pair graph as a feature: partners of a heading's nearest graph headings, compared with the candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import vectors as V


def graph_partners(heads: DataFrame, edges: DataFrame, units: DataFrame, near: int = K.GRAPH_NEAR) -> DataFrame:
    """(h_id, partner, weight): partners of the ``near`` graph headings nearest to each heading, itself left out.

    ``edges`` has (heading, partner) ids; a partner that several headings share stands once for each.
    """
    graph = edges.select(F.col("heading").alias("g")).distinct().join(units.select(F.col("id").alias("g"), F.col("unit").alias("g_unit")), "g")
    h = heads.select(F.col("id").alias("h_id"), F.col("unit").alias("h_unit"))
    sims = h.join(graph, F.col("h_id") != F.col("g")).select("h_id", "g", V.dot(F.col("h_unit"), F.col("g_unit")).alias("weight"))
    top = sims.withColumn("_r", F.row_number().over(Window.partitionBy("h_id").orderBy(F.desc("weight"), "g"))).where(F.col("_r") <= near)
    return top.join(edges.select(F.col("heading").alias("g"), "partner"), "g").select("h_id", "g", "partner", "weight")


def graph_scores(partners: DataFrame, candidates: DataFrame, units: DataFrame, k: int = K.GRAPH_PARTNERS) -> DataFrame:
    """(h_id, id, dsknn, has_graph): mean over the k most similar partners of similarity times weight; 0 without any.

    ``candidates`` has (h_id, id). Similarities are worked out once for each distinct (partner, candidate).
    """
    p = units.select(F.col("id").alias("partner"), F.col("unit").alias("p_unit"))
    c = units.select("id", "unit")
    reached = candidates.join(partners, "h_id")
    sims = reached.select("partner", "id").distinct().join(p, "partner").join(c, "id").select("partner", "id", V.dot(F.col("p_unit"), F.col("unit")).alias("sim"))
    joined = reached.join(sims, ["partner", "id"])
    order = Window.partitionBy("h_id", "id").orderBy(F.desc("sim"), "partner", "g")
    top = joined.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    scores = top.groupBy("h_id", "id").agg(F.avg(F.col("sim") * F.col("weight")).alias("dsknn"))
    return candidates.join(scores, ["h_id", "id"], "left").select("h_id", "id", F.coalesce("dsknn", F.lit(0.0)).alias("dsknn"), F.when(F.col("dsknn").isNotNull(), 1).otherwise(0).alias("has_graph"))


def cold_rate(candidates: DataFrame, partners: DataFrame) -> DataFrame:
    """Share of headings that no partner reaches."""
    heads = candidates.select("h_id").distinct()
    return heads.join(partners.select("h_id").distinct().withColumn("_k", F.lit(1)), "h_id", "left").agg(F.round(F.avg(F.when(F.col("_k").isNull(), 1.0).otherwise(0.0)), 6).alias("cold"))


def fold_graphs(heads: DataFrame, edges: DataFrame, units: DataFrame, near: int = K.GRAPH_NEAR) -> tuple[DataFrame, DataFrame]:
    """(graphs, cuts): (h_id, without, g, partner, weight), the ``graph_partners`` of every heading, and again for each graph
    heading left out; and the (h_id, without) for which that makes a difference.

    ``without`` is null for the whole graph. Only the headings among the ``near`` nearest change a heading's
    partners, so there are at most ``near`` further graphs a heading, whatever the number of folds.
    """
    graph = edges.select(F.col("heading").alias("g")).distinct().join(units.select(F.col("id").alias("g"), F.col("unit").alias("g_unit")), "g")
    h = heads.select(F.col("id").alias("h_id"), F.col("unit").alias("h_unit"))
    sims = h.join(graph, F.col("h_id") != F.col("g")).select("h_id", "g", V.dot(F.col("h_unit"), F.col("g_unit")).alias("weight"))
    top = sims.withColumn("_r", F.row_number().over(Window.partitionBy("h_id").orderBy(F.desc("weight"), "g"))).where(F.col("_r") <= near + 1)
    inner = top.where(F.col("_r") <= near)
    cuts = inner.select("h_id", F.col("g").alias("without"))
    left = top.join(cuts, "h_id").where(F.col("g") != F.col("without"))
    both = inner.select("h_id", F.lit(None).cast("long").alias("without"), "g", "weight").unionByName(left.select("h_id", "without", "g", "weight"))
    return both.join(edges.select(F.col("heading").alias("g"), "partner"), "g").select("h_id", "without", "g", "partner", "weight"), cuts


def fold_scores(graphs: DataFrame, candidates: DataFrame, units: DataFrame, k: int = K.GRAPH_PARTNERS) -> DataFrame:
    """(h_id, id, without, dsknn) of the (h_id, id) candidates under each graph of their heading; candidates that no partner reaches are left out."""
    p = units.select(F.col("id").alias("partner"), F.col("unit").alias("p_unit"))
    reached = candidates.select("h_id", "id").distinct().join(graphs, "h_id")
    sims = reached.select("partner", "id").distinct().join(p, "partner").join(units.select("id", "unit"), "id").select("partner", "id", V.dot(F.col("p_unit"), F.col("unit")).alias("sim"))
    order = Window.partitionBy("h_id", "id", "without").orderBy(F.desc("sim"), "partner", "g")
    top = reached.join(sims, ["partner", "id"]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return top.groupBy("h_id", "id", "without").agg(F.avg(F.col("sim") * F.col("weight")).alias("dsknn"))


def with_fold_feature(rows: DataFrame, scores: DataFrame, cuts: DataFrame, held: str | None) -> DataFrame:
    """Adds f_dsknn and f_has_graph to (h_id, id, ...) rows, of the graph without the heading in the column ``held`` (null or None: the whole)."""
    cut = F.lit(None).cast("long") if held is None else F.col(held)
    base = scores.where("without is null").select("h_id", "id", F.col("dsknn").alias("_whole"))
    if held is None:
        out = rows.join(base, ["h_id", "id"], "left").withColumn("_found", F.col("_whole"))
    else:
        near = scores.where("without is not null")
        changed = cuts.select("h_id", F.col("without").alias("_cut")).withColumn("_changed", F.lit(True))
        own = near.select("h_id", "id", F.col("without").alias("_cut"), F.col("dsknn").alias("_own"))
        out = rows.withColumn("_cut", cut).join(base, ["h_id", "id"], "left").join(changed, ["h_id", "_cut"], "left").join(own, ["h_id", "id", "_cut"], "left")
        out = out.withColumn("_found", F.when(F.col("_changed"), F.col("_own")).otherwise(F.col("_whole"))).drop("_cut", "_changed", "_own")
    return out.withColumns({"f_dsknn": F.coalesce("_found", F.lit(0.0)), "f_has_graph": F.when(F.col("_found").isNotNull(), 1.0).otherwise(0.0)}).drop("_found", "_whole")
