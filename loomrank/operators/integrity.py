"""Checks of a corpus before release, as tables of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def dense_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """One row: whether ids are 0 to n - 1."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.min(key).alias("low"), F.max(key).alias("high")).withColumn("dense", (F.col("rows") == F.col("ids")) & (F.col("low") == 0) & (F.col("high") == F.col("rows") - 1))


def foreign_sources(df: DataFrame, allowed: tuple[str, ...] = K.PUBLIC_SOURCES) -> DataFrame:
    return df.where(~F.col("source").isin(*allowed)).groupBy("source").agg(F.count("*").alias("rows"))


def unlike_dims(public: DataFrame, private: DataFrame, vector: str) -> DataFrame:
    """(dim, rows) of private vectors whose length is none of the public ones'; a merge needs this to be empty."""
    known = public.select(F.size(vector).alias("dim")).distinct()
    return private.groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("rows")).join(known, "dim", "left_anti")


def content_hash(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, sha256) of each row's columns as text."""
    return df.select(key, F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256).alias("sha256"))


def drifted(now: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """Keys whose hash changed, vanished or appeared."""
    both = now.select(key, F.col("sha256").alias("_a")).join(recorded.select(key, F.col("sha256").alias("_b")), key, "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(key, F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "missing").otherwise("changed").alias("change"))


def missing_files(root: str, required: tuple[str, ...]) -> list[str]:
    """Required files and folders that a release lacks."""
    import os

    return [name for name in required if not os.path.exists(os.path.join(root, name))]


def contract_differences(one: dict, other: dict) -> list[str]:
    """Fields of two contracts (nested as they are) that one lacks or that differ, by their dotted names."""
    out = []
    for key in sorted({*one, *other}):
        a, b = one.get(key), other.get(key)
        if isinstance(a, dict) and isinstance(b, dict):
            out += [f"{key}.{x}" for x in contract_differences(a, b)]
        elif key not in one or key not in other or a != b:
            out.append(key)
    return out


def projection_drift(spark, paths: dict[str, str]) -> DataFrame:
    """(corpus, identity) of corpora whose projection isn't that of the first one; the stored numbers are hashed again."""
    from .learn import Projection

    found = {name: Projection.read(spark, f"{path}/pca").identity for name, path in paths.items()}
    first = next(iter(found.values()), None)
    return spark.createDataFrame([(n, i) for n, i in found.items() if i != first], "corpus string, identity string")


def repeated_run(make, key: str, *columns: str) -> DataFrame:
    """Keys whose columns differ between two runs of ``make()``; empty for a deterministic one."""
    return drifted(content_hash(make(), key, *columns), content_hash(make(), key, *columns), key)


def failures(corpus: DataFrame, declared: dict) -> DataFrame:
    """(check, detail) for every declared count, size or contract that the corpus doesn't keep.

    ``declared`` has count, dim and houseFaces, and may have ``bytes`` (one a component of every row), ``catalog``
    (its number of rows), ``pca`` with rows and dim, and ``contracts``: by name a list of documents that must agree.
    """
    found = corpus.agg(F.count("*").alias("count"), F.max(F.size("q")).alias("dim"), F.min(F.size("q")).alias("least"), F.sum(F.size("q")).alias("bytes"), F.count_if(F.col("source") == "local").alias("house"), F.count_if(F.col("scale").isNull()).alias("unscaled"), F.max("id").alias("top"), F.countDistinct("id").alias("ids")).first()
    pca = declared.get("pca") or {}
    checks = [
        ("count", found["count"], declared["count"]), ("dim", found["dim"], declared["dim"]), ("least dim", found["least"], declared["dim"]), ("house faces", found["house"], declared["houseFaces"]),
        ("scales", found["unscaled"], 0), ("ids", (found["top"], found["ids"]), (declared["count"] - 1, declared["count"])), ("bytes", found["bytes"], declared.get("bytes", declared["count"] * declared["dim"])),
        ("catalog", declared.get("catalog", declared["count"]), declared["count"]), ("pca", pca.get("rows", declared["dim"]), declared["dim"]),
    ]
    rows = [(check, f"{have} is not {want}") for check, have, want in checks if have != want]
    rows += [("source", r["source"]) for r in foreign_sources(corpus).collect()]
    for name, documents in sorted(declared.get("contracts", {}).items()):
        for other in documents[1:]:
            same = isinstance(documents[0], dict) and isinstance(other, dict)
            rows += [("contract", f"{name}.{d}") for d in contract_differences(documents[0], other)] if same else [("contract", name)] * (documents[0] != other)
    return corpus.sparkSession.createDataFrame(rows, "check string, detail string")
