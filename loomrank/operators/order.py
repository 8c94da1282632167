"""Global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are dealt to; the driver sees their bounds and nothing else.
RANGES = 256


def running_before(df: DataFrame, value: str, tie: str | None = None, amount: Column | None = None, out: str = "before", ranges: int = RANGES) -> DataFrame:
    """Adds the sum of ``amount`` (1 by default) over rows that stand earlier by (value, tie).

    Rows are dealt to ranges of the value by approximate percentiles. A row's sum is that of all earlier
    ranges plus a running sum within its own, so no task holds more than a range. Values are numbers, not null.
    """
    points = df.select(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(p) for p in sorted(set(points))])
    dealt = df.withColumn("_range", F.size(F.filter(bounds, lambda p: p < F.col(value))) if points else F.lit(0)).withColumn("_amount", F.lit(1) if amount is None else amount)
    totals = dealt.groupBy("_range").agg(F.sum("_amount").alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    shift = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_shift"))
    keys = [value] if tie is None else [value, tie]
    within = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("_amount").over(within), F.lit(0))
    return dealt.withColumn("_own", own).join(shift, "_range").withColumn(out, F.col("_own") + F.col("_shift")).drop("_range", "_amount", "_own", "_shift")
