import zlib

import numpy as np
from pyspark.sql import functions as F

from loomrank.llm import sharding

MASK = (1 << 64) - 1


def jump(key, shards):
    """The published loop, one key at a time."""
    state = key & MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        state = ((state ^ (state >> shift)) * factor) & MASK
    state ^= state >> 31
    bucket, ahead = -1, 0
    while ahead < shards:
        bucket = ahead
        state = (state * 2862933555777941757 + 1) & MASK
        ahead = int((bucket + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return bucket


def test_jump_hash_against_the_loop():
    keys = np.concatenate([np.arange(500), [-1, -(2**63), 2**63 - 1]]).astype(np.int64)
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [jump(int(k), shards) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20_000)
    a, b = sharding.jump_hash(keys, 8), sharding.jump_hash(keys, 9)
    assert set(b[a != b]) == {8} and abs((a != b).mean() - 1 / 9) < 0.02
    assert np.bincount(a).min() > 2200


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = sharding.assign_shards(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        data = rows[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "key", jump(r["doc_id"], 8), jump(r["doc_id"], 9))
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_odd_rows_and_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, 5), (1, "", 5), (1, "", 5), (2, "é" * 100_000, 5)], "doc_id long, text string, size int")
    got = sharding.assign_shards(docs).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 1, 200_001]
    assert len({(r["shard"], r["slot"]) for r in got}) == 4
    assert {r["text_crc32"] for r in got if r["size"] == 1} == {0}
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4 and {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in got}


def test_keys_of_any_type(spark, tmp_path):
    """Equal keys of a type share a shard; null keys have one of their own, not that of 0."""
    rows = [(0, "a", 1.5, None), (1, "b", 2.5, None), (0, "a", 1.5, "x"), (None, None, None, "y")]
    docs = spark.createDataFrame(rows, "n int, s string, d double, text string").withColumns({"t": F.timestamp_seconds("n"), "b": F.col("s").cast("binary"), "m": F.col("n").cast("decimal(20,0)"), "shard": F.lit("own"), "_piece": F.lit(1)})
    for col in ("n", "s", "d", "t", "b", "m"):
        got = sharding.assign_shards(docs, 1000, id_col=col).collect()
        assert len(got) == 4
        by = {}
        for r in got:
            by.setdefault(str(r["doc_id"]), set()).add(r["shard"])
        assert all(len(x) == 1 for x in by.values()) and len(by) == 3
        assert by["None"] == {jump(sharding.NULL_KEY, 1000)} != {jump(0, 1000)}
    sharding.write_shards(docs, str(tmp_path / "any"), id_col="s")
    back = spark.read.parquet(str(tmp_path / "any"))
    assert set(back.columns) == {*docs.columns, "shard_"} and {r["shard"] for r in back.collect()} == {"own"}
