import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomrank.operators import graph as G
from loomrank.operators import learn as L
from loomrank.operators import neighbours as N
from loomrank.operators import pairing as P
from loomrank.plans import queries as Q
from loomrank.plans import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding").persist()


def test_pca_against_the_singular_vectors(spark, vectors):
    """Components are those of the kept rows' covariance, orthonormal, and give the least reconstruction error."""
    kept = F.col("id") % 11 != 0
    model = L.fit_pca(vectors, "embedding", 8, kept)
    x = np.array([r["embedding"] for r in vectors.where(kept).collect()], float)
    centred = x - x.mean(axis=0)
    _, s, v = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.components @ model.components.T, np.eye(8), atol=1e-8)
    assert np.allclose(np.abs((model.components * v[:8]).sum(axis=1)), 1, atol=1e-6)
    assert all(row[np.abs(row).argmax()] > 0 for row in model.components)
    lost = ((centred - centred @ model.components.T @ model.components) ** 2).sum()
    assert lost == pytest.approx((s[8:] ** 2).sum(), rel=1e-8)
    every = {r["id"]: (r["embedding"], r["projected"]) for r in L.pca_project(vectors, "embedding", model).collect()}
    assert len(every) == vectors.count() and all(np.allclose((np.array(e) - model.mean) @ model.components.T, p) for e, p in every.values())
    some = spark.createDataFrame([(1, None), (2, [0.0] * 64)], "id long, embedding array<double>")
    assert {r["id"]: r["projected"] is None for r in L.pca_project(some, "embedding", model).collect()} == {1: True, 2: False}


def test_frozen_projection(spark, tmp_path):
    model = L.Projection(np.arange(3.0), np.arange(6.0).reshape(2, 3))
    model.write(spark, str(tmp_path / "pca"))
    back = L.Projection.read(spark, str(tmp_path / "pca"))
    assert back.identity == model.identity and np.array_equal(back.mean, model.mean)
    spark.createDataFrame([([9.0, 1.0, 2.0], [[0.0]], model.identity)], "mean array<double>, components array<array<double>>, identity string").write.parquet(str(tmp_path / "forged"))
    with pytest.raises(ValueError, match="numbers"):
        L.Projection.read(spark, str(tmp_path / "forged"))


def test_dual_space(spark):
    a = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "id long, unit array<double>")
    b = spark.createDataFrame([(0, [0.6, 0.8]), (1, [1.0, 0.0])], "id long, unit array<double>")
    got = {r["id"]: np.array(r["unit"]) for r in L.dual(a, b).collect()}
    assert set(got) == {0, 1} and np.allclose(got[0], np.array([1, 0, 0.6, 0.8]) / math.sqrt(2))


def test_legibility_is_the_optimum_of_its_loss(spark):
    """Class weights n / (2 n_c), penalty |w|^2 / 2 beside the summed loss: at the fit both gradients vanish."""
    corpus = view.corpus(spark, SF)
    positive, negative = "category in ('ECONOMY', 'STANDARD')", "category in ('LARGE', 'PROMO')"
    got = {r["id"]: r["legibility"] for r in L.legibility_proxy(corpus, positive, negative).collect()}
    rows = corpus.withColumn("y", F.when(F.expr(positive), 1.0).when(F.expr(negative), 0.0)).select("id", "unit", "y").collect()
    assert len(got) == len(rows) and all(0 < p < 1 for p in got.values())
    train = [r for r in rows if r["y"] is not None]
    x, y, p = np.array([r["unit"] for r in train]), np.array([r["y"] for r in train]), np.array([got[r["id"]] for r in train])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    z = np.log(p / (1 - p))
    w, *_ = np.linalg.lstsq(np.column_stack([x, np.ones(len(x))]), z, rcond=None)
    assert np.abs(x.T @ (weight * (p - y)) + w[:-1]).max() < 1e-4 and abs((weight * (p - y)).sum()) < 1e-4


def test_standardized_fit_is_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 3)) * [1, 50, 0.01] + [5, 0, 1]
    y = (x @ [1, -0.05, 30] - 35 + rng.standard_normal(300) * 2 > 0).astype(int)
    rows = spark.createDataFrame([(0, 1, i, int(y[i]), *map(float, x[i])) for i in range(300)] + [(1, 1, i, 1, 0.0, 0.0, 0.0) for i in range(5)], "k int, h_id long, id long, y int, a double, b double, c double")
    (model,) = L.fit_by(rows, ("k",), ("a", "b", "c")).collect()  # one label alone gives no model
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-9
    z, w = (x - mean) / sd, np.array(model["weights"]) * sd
    p = 1 / (1 + np.exp(-(x @ model["weights"] + model["bias"])))
    assert np.abs(z.T @ (p - y) + w).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_averages_and_held_out_rows(spark):
    models = spark.createDataFrame([(0, 0, [1.0, 2.0], 1.0), (0, 1, [3.0, 2.0], 0.0), (1, 0, [0.0, 0.0], 5.0)], "held long, seed int, weights array<double>, bias double")
    got = {r["held"]: (r["weights"], r["bias"], r["spread"]) for r in L.averaged(models, "held").collect()}
    assert got == {0: ([2.0, 2.0], 0.5, [1.0, 0.0]), 1: ([0.0, 0.0], 5.0, [0.0, 0.0])}
    rows = spark.createDataFrame([(f,) for f in (0, 1, 2)], "fold long")
    assert sorted((r["fold"], r["held"]) for r in L.held_out(rows, 3).collect()) == [(f, h) for f in range(3) for h in range(3) if f != h]
    z = L.z_scored(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 7.0)], "h int, v double"), "v", ("h",), "z").collect()
    assert sorted(round(r["z"], 6) for r in z) == [-1.0, 0.0, 1.0]


def plain_dsknn(units, edges, heading, candidate, without=None, k=10):
    """The graph feature by its definition: nearest graph headings, their partners with the heading's cosine, the most similar of these."""
    heads = {h for h, _ in edges} - {heading, without}
    near = sorted(heads, key=lambda g: (-float(units[heading] @ units[g]), g))[:k]
    reach = [(p, float(units[heading] @ units[g]), g) for g in near for h, p in edges if h == g]
    if not reach:
        return None
    sims = sorted(((-float(units[candidate] @ units[p]), p, g, w) for p, w, g in reach))[:k]
    return float(np.mean([-s * w for s, _, _, w in sims]))


def test_graph_features_by_fold(spark):
    rng = np.random.default_rng(3)
    units = rng.standard_normal((30, 6))
    units /= np.linalg.norm(units, axis=1)[:, None]
    edges = sorted({(int(h), int(p)) for h in range(14) for p in rng.choice(np.arange(14, 30), 2)})
    table = spark.createDataFrame([(i, u.tolist()) for i, u in enumerate(units)], "id long, unit array<double>")
    graph = spark.createDataFrame(edges, "heading long, partner long")
    heads = table.where("id < 14")
    graphs, cuts = G.fold_graphs(heads, graph, table, near=10)
    rows = spark.createDataFrame([(h, c, w) for h in (0, 5, 13) for c in (15, 22, 29) for w in (None, *range(14)) if w != h], "h_id long, id long, held long")
    scores = G.fold_scores(graphs, rows, table)
    for r in G.with_fold_feature(rows, scores, cuts, "held").collect():
        want = plain_dsknn(units, edges, r["h_id"], r["id"], r["held"])
        assert r["f_has_graph"] == 1.0 and r["f_dsknn"] == pytest.approx(want, abs=1e-12)
    lone = spark.createDataFrame([(1, 20)], "heading long, partner long")
    graphs, cuts = G.fold_graphs(heads.where("id < 3"), lone, table)
    asked = spark.createDataFrame([(0, 15, None), (0, 15, 1), (1, 15, None), (2, 15, 0)], "h_id long, id long, held long")
    got = {(r["h_id"], r["held"]): r["f_has_graph"] for r in G.with_fold_feature(asked, G.fold_scores(graphs, asked, table), cuts, "held").collect()}
    assert got == {(0, None): 1.0, (0, 1): 0.0, (1, None): 0.0, (2, 0): 1.0}


def test_reranker_leaves_each_heading_out(spark):
    """Models of two folds refitted in numpy on rows and graph features that leave the fold's heading out; ranks by plain sorting."""
    t = Q.ranker_tables(spark, SF)
    models = L.averaged(Q.loocv_models(t, seeds=1).persist(), "held", "seed")
    fold = {r["h_id"]: r["fold"] for r in t["folds"].collect()}
    units = {r["id"]: np.array(r["unit"]) for r in t["units"].collect()}
    edges = sorted((r["heading"], r["partner"]) for r in t["edges"].collect())
    rows = L.training_rows(t["pairs"], t["positives"], t["excluded"], 1, Q.NEGATIVES).toPandas()
    pairs = t["pairs"].toPandas()
    own = {r["held"]: r for r in models.collect()}
    ranks = {r["h_id"]: r["best"] for r in Q.loocv_ranks(t, models.drop("spread")).collect()}
    assert set(ranks) == set(fold) and len(own) == len(fold) > 5
    assert (rows.groupby("h_id")["y"].sum() >= 1).all() and (rows.groupby("h_id")["y"].apply(lambda y: (y == 0).sum()) <= Q.NEGATIVES).all()
    excluded = {(r["h_id"], r["id"]) for r in t["excluded"].collect()}
    assert not any((h, i) in excluded for h, i, y in zip(rows["h_id"], rows["id"], rows["y"]) if y == 0)
    for heading in sorted(fold)[:2]:
        train = rows[rows["h_id"] != heading].sort_values(["h_id", "id", "y"], kind="stable")
        ds = [plain_dsknn(units, edges, h, c, heading) for h, c in zip(train["h_id"], train["id"])]
        x = np.column_stack([train[list(P.STATIC_FEATURES)].to_numpy(float), [d or 0.0 for d in ds], [float(d is not None) for d in ds]])
        w, b = L.fit_standardized(x, train["y"].to_numpy(float))
        assert np.allclose(own[fold[heading]]["weights"], w, rtol=1e-5, atol=1e-6) and own[fold[heading]]["bias"] == pytest.approx(b, rel=1e-5, abs=1e-6)
        test = pairs[pairs["h_id"] == heading]
        ds = [plain_dsknn(units, edges, heading, c) for c in test["id"]]
        scores = b + np.column_stack([test[list(P.STATIC_FEATURES)].to_numpy(float), [d or 0.0 for d in ds], [float(d is not None) for d in ds]]) @ w
        order = sorted(zip(-scores, test["id"]))
        place = {i: k + 1 for k, (_, i) in enumerate(order)}
        assert abs(ranks[heading] - min(place[p] for h, p in edges if h == heading)) <= 1


def test_metric_gradient_and_fit():
    rng = np.random.default_rng(4)
    x, y, sign = rng.standard_normal((40, 5)), rng.standard_normal((40, 5)), np.where(np.arange(40) % 2, 1.0, -1.0)
    lower, skew = rng.standard_normal((5, 5)) * 0.3, rng.standard_normal((5, 5)) * 0.3
    _, gl, gs = L.metric_loss(x, y, sign, lower, skew, 0.7)
    for param, gradient in ((lower, gl), (skew, gs)):
        for at in ((0, 0), (1, 3), (4, 2)):
            keep = param[at]
            param[at] = keep + 1e-6
            up = L.metric_loss(x, y, sign, lower, skew, 0.7)[0]
            param[at] = keep - 1e-6
            down = L.metric_loss(x, y, sign, lower, skew, 0.7)[0]
            param[at] = keep
            assert gradient[at] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)
    moved, turned = L.fit_metric(x, y, sign)
    assert not moved.any() and turned.any()  # from 0 the metric's own part stays
    before = L.metric_loss(x, y, sign, np.zeros((5, 5)), np.zeros((5, 5)))[0]
    assert L.metric_loss(x, y, sign, moved, turned)[0] < before
    assert L.metric_loss(x, y, sign, *L.fit_metric(x, y, sign, start=0.1))[0] < before


def test_metric_scores_and_models(spark):
    rng = np.random.default_rng(5)
    rows = [(k, h, i, int(i < 3), rng.standard_normal(4).tolist(), rng.standard_normal(4).tolist()) for k in (0, 1) for h in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "held long, h_id long, id long, y int, x array<double>, z array<double>")
    models = L.fit_metric_by(df, ("held",)).persist()
    known = {r["held"]: (np.array(r["lower"]).reshape(4, 4), np.array(r["skew"]).reshape(4, 4)) for r in models.collect()}
    frame = pd.DataFrame(rows, columns=["held", "h_id", "id", "y", "x", "z"])
    for held in (0, 1):
        part = frame[frame["held"] == held].sort_values(["h_id", "id", "y"], kind="stable")
        want = L.fit_metric(np.stack(part["x"]), np.stack(part["z"]), np.where(part["y"] == 1, 1.0, -1.0))
        assert np.allclose(known[held][0], want[0]) and np.allclose(known[held][1], want[1])
    more = df.unionByName(df.limit(1).withColumn("held", F.lit(9).cast("long")))
    for r in L.metric_scores(more, models, ["held"]).collect():
        if r["held"] == 9:
            assert r["metric"] is None
            continue
        lower, skew = known[r["held"]]
        x, z = np.array(r["x"]), np.array(r["z"])
        gap = x - z
        assert r["metric"] == pytest.approx(x @ (np.eye(4) + skew) @ z - gap @ (np.eye(4) + lower @ lower.T) @ gap)


def test_standardized_components(spark):
    x = np.random.default_rng(6).standard_normal((50, 4)) * [1, 2, 3, 4] + 7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    got = np.array([r["x"] for r in L.standardized(df, "v", 3).orderBy("id").collect()])
    assert np.allclose(got, (x[:, :3] - x[:, :3].mean(axis=0)) / (x[:, :3].std(axis=0) + 1e-9))


def test_neighbours_in_small_blocks(spark):
    """Blocks of three rows, repeated vectors, and searches within and apart."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((40, 5))
    v[20:30] = v[:10]
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(i, u.tolist(), i % 3, i % 4) for i, u in enumerate(v)], "id long, unit array<double>, a int, b int")
    for within, apart in ((None, None), ("a", None), (None, "b"), ("a", "b")):
        got = {}
        for r in N.knn(df, 4, block=3, within=within, apart=apart).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append(r["near"])
        cos = np.array([[np.add.accumulate(v[i] * v[j])[-1] for j in range(40)] for i in range(40)])
        for i in range(40):
            others = [j for j in range(40) if j != i and (not within or i % 3 == j % 3) and (not apart or i % 4 != j % 4)]
            assert got[i] == sorted(others, key=lambda j: (-cos[i, j], j))[:4]
    assert N.knn(df.limit(1), 3).count() == 0
