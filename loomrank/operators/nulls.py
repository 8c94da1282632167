"""Null pairs by a counted generator, the same on every engine and at every parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import RANGES, running_before

#: Fixed values of the 32-bit generator: what its state grows by, and the factor of its second round.
STEP, SECOND = 0x6D2B79F5, 61
_MASK = 0xFFFFFFFF


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two numbers of 32 bits, by halves, so that nothing leaves 64 bits."""
    return (a * b.bitwiseAND(0xFFFF) + F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_MASK)


def mulberry(index: Column, seed: int = 0) -> Column:
    """The number, from 0 to 2**32 - 1, that the 32-bit generator gives at a place of its sequence (from 0).

    Its state grows by a constant, so any place is worked out on its own and a sequence needs no order of rows.
    """
    bits = lambda x, n: F.shiftright(x, n)  # noqa: E731  numbers here are never negative
    state = (F.lit(seed).cast("long") + (index.cast("long") + 1) * STEP).bitwiseAND(_MASK)
    t = _times(state.bitwiseXOR(bits(state, 15)), state.bitwiseOR(1))
    t = ((t + _times(t.bitwiseXOR(bits(t, 7)), t.bitwiseOR(SECOND))).bitwiseAND(_MASK)).bitwiseXOR(t)
    return t.bitwiseXOR(bits(t, 14))


def draw(place: Column, n: Column, seed: int = 0) -> Column:
    """A number from 0 to n - 1 (n up to 2**31) at a place of the generator's sequence."""
    return F.shiftright(mulberry(place, seed) * n, 32)


def uniform_pairs(pool: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, a, b) ids, exactly ``draws`` rows: both ends uniform over the pool. A draw of one id twice is drawn again.

    The second draw of such a pair is uniform over the other ids, which is what drawing until they differ gives;
    a pool of fewer than two ids gives no pair.
    """
    spark = pool.sparkSession
    numbered = running_before(pool.select("id"), "id", out="at")
    n = numbered.agg(F.count("*").alias("n"))
    drawn = spark.range(draws).join(F.broadcast(n)).where("n > 1").select(F.col("id").alias("draw"), "n", *[draw(3 * F.col("id") + k, n_, seed).alias(c) for k, (n_, c) in enumerate(((F.col("n"), "x"), (F.col("n"), "_y"), (F.col("n") - 1, "_again")))])
    drawn = drawn.select("draw", "x", F.when(F.col("_y") != F.col("x"), F.col("_y")).otherwise((F.col("x") + 1 + F.col("_again")) % F.col("n")).alias("y"))
    one = numbered.select(F.col("at").alias("x"), F.col("id").alias("a"))
    two = numbered.select(F.col("at").alias("y"), F.col("id").alias("b"))
    return drawn.join(one, "x").join(two, "y").select("draw", "a", "b")


def weighted_draws(weights: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, id) in proportion to integer weights: each draw finds its place in the running sum of the weights.

    Places and sums are dealt to ranges of the sum of equal width: an id sends a row to each range that it
    reaches into, so a heavy id costs as many rows as ranges and no more.
    """
    spark = weights.sparkSession
    spans = running_before(weights.select("id", "weight"), "id", amount=F.col("weight"), out="start").withColumn("stop", F.col("start") + F.col("weight"))
    total = weights.agg(F.sum("weight").alias("n"))
    width = F.greatest(F.lit(1), F.floor(F.col("n") / RANGES)).cast("long")
    drawn = spark.range(draws).join(F.broadcast(total)).select(F.col("id").alias("draw"), draw(F.col("id"), F.col("n"), seed).alias("u"), width.alias("w")).withColumn("range", F.floor(F.col("u") / F.col("w")))
    reach = spans.where("weight > 0").join(F.broadcast(total)).select("id", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("range"))
    return drawn.join(reach, "range").where((F.col("u") >= F.col("start")) & (F.col("u") < F.col("stop"))).select("draw", "id")


def hashed_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows in a hashed order: the feature is the sample's size."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)
