"""Bounded labelled samples and exact selection by rank, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import written

#: Labelled rows that a classifier is fitted on, at most; also the proven bound of what is broadcast.
SAMPLE_ROWS = 20_000


def labelled_sample(labels: DataFrame, label_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled ids, those of the smallest hash; null ids and labels are left out."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return written(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "sample")


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counts of ever narrower ranges; None if k is 0.

    Each round counts the rows in at most 65,536 ranges, so what the driver gets doesn't grow with the rows.
    """
    if k <= 0:
        return None
    low, left = None, k
    for shift in (48, 32, 16, 0):
        part = F.shiftright(column, shift)
        within = keys if low is None else keys.where(F.shiftright(F.col(column), shift + 16) == low)
        counts = sorted(((r["p"], r["n"]) for r in within.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for p, n in counts:
            low = p
            if left <= n:
                break
            left -= n
    return low
