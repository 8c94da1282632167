"""Sharding by jump consistent hashing.

A row's shard is a function of its key and the number of shards alone: no ring table, no state. Growing
from n to n+1 shards moves only the rows that the new shard takes, about 1/(n+1) of all.

A key of an integer type counts as it is; one of any other type counts as its 64-bit hash (a decimal, date or
time as its text).

Results for odd input: a null key counts as a constant of its own and stays deterministic; a null text
has size 1 and checksum 0, as the empty text; repeated rows get a slot each; an empty table gives an
empty result; further columns of the input are ignored, and kept by ``write_shards`` whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StringType

from ._runtime import free_name, written
from ._text import mix

#: rows that one slot-numbering bucket is meant to hold
BUCKET_ROWS = 50_000
#: key of rows without an id
NULL_KEY = -0x61C8864680B583EB


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last bucket its own pseudo-random jumps reach below ``shards``."""
    state = mix(keys.astype(np.uint64))
    bucket = np.zeros(len(state), dtype=np.int64)
    reach = np.zeros(len(state), dtype=np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        bucket[open_] = reach[open_]
        s = state[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        state[open_] = s
        ahead = (bucket[open_] + 1) * (float(1 << 31) / ((s >> np.uint64(33)).astype(np.float64) + 1.0))
        reach[open_] = np.minimum(ahead, 2.0**62).astype(np.int64)
        open_ = open_[reach[open_] < shards]
    return bucket


def key_of(df: DataFrame, id_col: str) -> Column:
    """The 64-bit key of a row's id."""
    kind = df.schema[id_col].dataType
    key = F.col(id_col).cast("long") if isinstance(kind, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col) if isinstance(kind, (StringType, BinaryType)) else F.col(id_col).cast("string")))
    return F.coalesce(key, F.lit(NULL_KEY))


def shards_of(key: Column, *shards: int) -> Column:
    """Column form of ``jump_hash`` for several numbers of shards at once: a struct of n0, n1, ..."""

    @F.pandas_udf(", ".join(f"n{i} int" for i in range(len(shards))))
    def jump(k: pd.Series) -> pd.DataFrame:
        keys = k.to_numpy(dtype=np.int64)
        return pd.DataFrame({f"n{i}": jump_hash(keys, n).astype(np.int32) for i, n in enumerate(shards)})

    return jump(key)


def assign_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Slots are gapless from 0 in each shard. They are numbered without gathering a shard in one task: rows
    are dealt to buckets by key and checksum, numbered within (bucket, shard), and shifted by the sizes of the
    shard's earlier buckets. Texts are read once, for a table of id, size and checksum; only that is shuffled.
    """
    rows = docs.select(
        key_of(docs, id_col).alias("key"),
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    buckets = max(32, docs.count() // BUCKET_ROWS)
    rows = rows.withColumns({"jump": shards_of(F.col("key"), shards, shards + 1), "bucket": F.pmod(F.pmod("key", F.lit(buckets)) + F.pmod("text_crc32", F.lit(buckets)), F.lit(buckets)).cast("int")})
    rows = written(rows.select("doc_id", "size", "text_crc32", "bucket", F.col("jump.n0").alias("shard"), F.col("jump.n1").alias("grown_shard")), "sharded")
    sizes = rows.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("bucket", "shard").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("own", F.row_number().over(within) - 1)
        .join(shift, ["bucket", "shard"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("own") + F.col("shift")).cast("long").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id") -> None:
    """Write the rows as Parquet, one folder per ``shard`` (``shard_`` where a column has that name); existing data is never overwritten.

    Rows are spread over hashed pieces of each shard before the write, so no task holds a whole shard.
    """
    pieces = max(1, docs.count() // (shards * BUCKET_ROWS) + 1)
    shard, piece = (free_name(docs, n) for n in ("shard", "_piece"))
    dealt = docs.withColumns({shard: shards_of(key_of(docs, id_col), shards)["n0"], piece: F.pmod(F.xxhash64(key_of(docs, id_col), F.lit(1)), F.lit(pieces))})
    dealt.repartition(shards * pieces, shard, piece).drop(piece).write.mode("errorifexists").partitionBy(shard).parquet(path)
