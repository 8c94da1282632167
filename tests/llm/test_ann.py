import math

import numpy as np
from pyspark.sql import functions as F

from loomrank.llm import ann


def brute(rows, k, every):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            near = sorted((-float((q * c).sum() / (np.sqrt((q * q).sum()) * np.sqrt((c * c).sum()))), j) for j, c in good if j != i and len(c) == len(q))
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_recall_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, 5, 10)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, 5, candidates=128, queries=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.97
    exact = {i: np.array(v, float) for i, v in rows}
    for q, near in got.items():
        assert [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        for i, s in near:
            assert abs(s - exact[q] @ exact[i] / np.linalg.norm(exact[q]) / np.linalg.norm(exact[i])) < 1e-12


def test_odd_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(12)] + [(12, None), (13, [0.0, 0.0, 0.0]), (14, [1.0, None, 1.0]), (15, [float("nan"), 1.0, 1.0]), (20, [float("inf"), 1.0, 1.0]), (None, same), (30, [1.0, 2.0]), (31, [2.0, 1.0]), (10, [-1.0, 0.0, 1.0]), (40, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, d int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, 5, candidates=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got[0] == [1, 2, 3, 4, 5] and got[30] == [31]
    assert set(got) == {0, 10, 30}
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_smallest_and_largest_doubles(spark):
    """Squares that leave the range of doubles change nothing."""
    rows = [(0, [1e-200, 2e-200]), (1, [2e-200, 1e-200]), (2, [1.0, 2.0]), (3, [1e200, -1e200]), (4, [5e-324, 0.0]), (10, [-1e300, 3e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    plain = {i: np.array(v) / max(map(abs, v)) for i, v in rows}
    for q in (0, 10):
        want = sorted((-round(float(plain[q] @ plain[i] / np.linalg.norm(plain[q]) / np.linalg.norm(plain[i])), 12), i) for i in plain if i != q)
        assert got[q] == [(i, -s) for s, i in want]


def test_repeated_rows_and_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (2, [0.2, 1.0])]
    df = spark.createDataFrame([(i, v, True) for i, v in rows], "vec_id long, embedding array<double>, _query boolean").repartition(3)
    got = sorted((r["vec_id"], round(r["score"], 6)) for r in ann.nearest(df, F.col("vec_id") == 2, 9).collect())
    assert [i for i, _ in got] == [0, 0, 1, 1]


def test_error_bound_holds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 60))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, fit = ann.encode(x)
    q = x[0] + 0.3 * rng.standard_normal(60) / 8
    q /= np.linalg.norm(q)
    guess, bound = ann.estimate(codes, fit, q[None])
    assert (np.abs(guess[0] - x @ q) <= bound).mean() > 0.99
    assert codes.shape == (4000, 8) and codes.dtype == np.uint8
