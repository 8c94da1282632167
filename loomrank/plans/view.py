"""The corpus over the driver tables, as a DataFrame and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import canonical, pool, with_unit
from ..operators.pairing import with_products, with_role_terms


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as catalog rows: brand is the family, type the category, size the weight and style."""
    size, key = F.col("p_size"), F.col("p_partkey")
    missing = lambda every, value: F.when(key % every != 0, value)
    return load(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_brand").alias("family"), F.col("p_type").alias("category"), (300 + 100 * (size % 7)).alias("weight"),
        F.when(size % 2 == 0, "normal").otherwise("italic").alias("style"), (F.col("p_type") != "PROMO").alias("eligible"), F.col("p_type").isin("ECONOMY", "STANDARD").alias("serif"),
        missing(17, F.lit(0.4) + (size % 10) / 40.0).alias("xh"), missing(19, F.lit(0.8) + (key % 13) / 20.0).alias("width"), missing(23, (key % 101) / 100.0).alias("legibility"),
        missing(29, (key % 53) / 50.0).alias("stroke"), missing(31, (key % 71) / 70.0).alias("aperture"),
        F.when(key % 11 == 0, "local").otherwise("google").alias("source"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("topic"))
    return with_unit(catalog(spark, sf_dir).join(vectors, "id"), "embedding").drop("embedding")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical headings against their pools, with the products' parts."""
    c = corpus(spark, sf_dir)
    return with_products(pool(canonical(c), c))


def role_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_role_terms(pairs(spark, sf_dir))


CATALOG = """
catalog AS (
  SELECT p_partkey AS id, p_brand AS family, p_type AS category, 300 + 100 * (p_size % 7) AS weight,
    CASE WHEN p_size % 2 = 0 THEN 'normal' ELSE 'italic' END AS style, p_type <> 'PROMO' AS eligible, p_type IN ('ECONOMY', 'STANDARD') AS serif,
    CASE WHEN p_partkey % 17 <> 0 THEN CAST(0.4 AS DOUBLE) + (p_size % 10) / CAST(40 AS DOUBLE) END AS xh,
    CASE WHEN p_partkey % 19 <> 0 THEN CAST(0.8 AS DOUBLE) + (p_partkey % 13) / CAST(20 AS DOUBLE) END AS width,
    CASE WHEN p_partkey % 23 <> 0 THEN (p_partkey % 101) / CAST(100 AS DOUBLE) END AS legibility,
    CASE WHEN p_partkey % 29 <> 0 THEN (p_partkey % 53) / CAST(50 AS DOUBLE) END AS stroke, CASE WHEN p_partkey % 31 <> 0 THEN (p_partkey % 71) / CAST(70 AS DOUBLE) END AS aperture,
    CASE WHEN p_partkey % 11 = 0 THEN 'local' ELSE 'google' END AS source
  FROM part)"""

CORPUS = CATALOG + """,
vectors AS (SELECT vec_id AS id, label AS topic, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
lengths AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vectors),
units AS (SELECT id, topic, list_transform(v, lambda x: x / CASE WHEN n = 0 THEN 1 ELSE n END) AS unit FROM lengths),
corpus AS (SELECT c.*, u.topic, u.unit FROM catalog c JOIN units u USING (id)),
canonical AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY CASE WHEN weight = 400 AND style = 'normal' THEN 0 WHEN weight = 400 THEN 1 ELSE 2 END, id) AS rn FROM corpus WHERE eligible) WHERE rn = 1)"""

PAIRS = CORPUS + """,
met AS (
  SELECT h.id AS h_id, h.family AS h_family, h.category AS h_category, h.weight AS h_weight, h.serif AS h_serif, h.xh AS h_xh, h.width AS h_width, h.legibility AS h_legibility, h.stroke AS h_stroke, h.aperture AS h_aperture, h.unit AS h_unit,
    c.id, c.family, c.category, c.weight, c.style, c.serif, c.xh, c.width, c.legibility, c.stroke, c.aperture, c.unit, list_transform(list_zip(h.unit, c.unit), lambda z: z[1] * z[2]) AS m
  FROM canonical h JOIN corpus c ON h.family <> c.family WHERE c.eligible),
parts AS (SELECT *, list_sum(list_transform(m, lambda x: greatest(x, CAST(0 AS DOUBLE)))) AS p, list_sum(list_transform(m, lambda x: greatest(-x, CAST(0 AS DOUBLE)))) AS n, list_sum(m) AS cos FROM met),
pairs AS (SELECT * EXCLUDE (m), p * n AS contrast FROM parts)"""

ROLE = PAIRS + """,
terms AS (
  SELECT *, contrast / CASE WHEN max(contrast) OVER (PARTITION BY h_id) > 0 THEN max(contrast) OVER (PARTITION BY h_id) ELSE 1 END AS cn,
    CASE WHEN h_serif <> serif THEN CAST(1 AS DOUBLE) ELSE 0 END AS serif_split, coalesce(exp(-abs(h_xh - xh) / CAST(0.05 AS DOUBLE)), 0) AS gate,
    CASE WHEN h_xh IS NULL OR xh IS NULL THEN 0 ELSE 1 - least(CAST(1 AS DOUBLE), abs(h_xh - xh) / CAST(0.15 AS DOUBLE)) END AS xh_match,
    CASE WHEN h_width IS NULL OR width IS NULL THEN 0 ELSE 1 - least(CAST(1 AS DOUBLE), abs(h_width - width) / CAST(0.3 AS DOUBLE)) END AS width_match,
    coalesce(legibility, 0.5) AS leg
  FROM pairs),
scored AS (
  SELECT *, cn - 0 * cos + CAST(0.2 AS DOUBLE) * serif_split * gate + CAST(0.5 AS DOUBLE) * xh_match + CAST(0.5 AS DOUBLE) * width_match AS head_score,
    cn - 0 * cos + CAST(0.2 AS DOUBLE) * serif_split * gate + CAST(0.5 AS DOUBLE) * xh_match + CAST(0.5 AS DOUBLE) * width_match + CAST(0.5 AS DOUBLE) * leg AS body_score FROM terms)"""
