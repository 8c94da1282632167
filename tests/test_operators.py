import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrank.functions import text as T
from loomrank.functions import vectors as V
from loomrank.operators import corpus as C
from loomrank.operators import evaluate as E
from loomrank.operators import graph as G
from loomrank.operators import integrity as I
from loomrank.operators import mining as M
from loomrank.operators import nulls as U
from loomrank.operators import pairing as P
from loomrank.operators import render as R
from loomrank.operators import stages as S

TINY = "id long, family string, weight int, style string, category string, serif boolean, eligible boolean, xh double, width double, legibility double, unit array<double>"


@pytest.fixture(scope="module")
def tiny(spark):
    rows = [
        (0, "Alpha", 400, "normal", "serif", True, True, 0.7, None, 0.5, [1.0, 0.0, 0.0]), (1, "Beta", 400, "normal", "sans", False, True, 0.7, None, 0.9, [0.6, 0.8, 0.0]),
        (2, "Gamma", 400, "normal", "sans", False, True, 0.7, None, 0.1, [0.6, -0.8, 0.0]), (3, "Alpha Bold", 700, "normal", "serif", True, True, 0.7, None, 0.5, [1.0, 0.0, 0.0]),
    ]
    return spark.createDataFrame(rows, TINY)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_kernels(spark):
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    m = V.products(arr(1, 2, -1), arr(3, -1, -2))
    assert one(spark, V.contrast(m)) == (3 + 2) * 2
    assert one(spark, V.quantize(arr(0.5, -0.25, 1 / 254), F.lit(0.5))) == [127, -64, 1]
    assert one(spark, V.quantize_scale(arr(0, 0))) == 1.0
    assert one(spark, V.gate(F.lit(None).cast("double"), F.lit(0.5))) == 0.0
    assert one(spark, V.match(F.lit(0.5), F.lit(None).cast("double"), 0.15, -1.0)) == -1.0
    assert one(spark, V.match(F.lit(0.5), F.lit(0.9), 0.15)) == 0.0
    assert one(spark, V.js_round(F.lit(2.345), 2)) == 2.35 and one(spark, V.js_round(F.lit(-0.5), 0)) == 0.0
    assert one(spark, V.project(arr(1, 2), arr(1, 1), F.array(arr(2, 3)))) == [3.0]
    assert one(spark, V.lightness(F.lit(800))) == -1.0
    assert one(spark, V.scaled(arr(0, 0), F.lit(0.0))) == [0.0, 0.0]


def test_text_functions(spark):
    s = lambda x: F.lit(x)
    assert one(spark, T.slug(s("--Two  Words_3!"))) == "two-words-3"
    assert one(spark, T.kin(s("Noto Sans"), s("Noto Serif"))) and not one(spark, T.kin(s("Noto Sans"), s("Roboto"))) and not one(spark, T.kin(s("Open Sans"), s("Open Circle")))
    assert one(spark, T.prefixes_without_qualifiers(s("Work  Sans Semi-Bold Italic"))) == ["Work Sans Semi-Bold Italic", "Work Sans Semi-Bold", "Work Sans"]
    assert one(spark, T.prefixes_without_qualifiers(s("Work Sans Semibold Italic"))) == ["Work Sans Semibold Italic", "Work Sans Semibold"]
    assert one(spark, T.kin(s("Space Grotesk"), s("Space Mono"))) and one(spark, T.kin(s("Alegreya SC"), s("Alegreya"))) and not one(spark, T.kin(s("Roboto Flex"), s("Roboto Mono")))
    assert one(spark, T.cleaned_name(s(" A &amp; B&nbsp; C ;.!"))) == "A & B C" and one(spark, T.cleaned_name(s("Old (trial) Face,"), parentheses=False)) == "Old Face"
    assert one(spark, T.prefixes_without_qualifiers(s("Bold"))) == ["Bold"]
    assert one(spark, T.families_of_stylesheet(s("https://x/css2?family=Open+Sans:wght@400&family=A%20B"))) == ["Open Sans", "A B"]
    assert one(spark, T.css_families(s("h1{font-family: 'Alpha X', serif} p{font-family:Beta}"))) == ["Alpha X", "Beta"]
    assert one(spark, T.pair_headings(s("3. Alpha One & Beta\nBest: Gamma + Delta Two"))) == [["Alpha One", "Beta"], ["Gamma", "Delta Two"]]
    assert one(spark, T.strip_tags(s("<p>a &amp; b</p>"))) == "a & b" and one(spark, T.escape_html(s('<a "b">&'))) == "&lt;a &quot;b&quot;&gt;&amp;"
    assert one(spark, T.name_words(s("MyFont-BoldItalic2"))) == ["my", "font", "bold", "italic"]
    assert one(spark, T.weight_of_words(s("X extrabold"))) == 800 and one(spark, T.weight_of_words(s("Bolder"))) == 400
    assert one(spark, T.style_of(s("A"), F.lit(2), F.lit(0))) == "italic" and one(spark, T.style_of(s("Oblique"), F.lit(0), F.lit(0))) == "italic"
    guess = lambda *v: one(spark, T.category_guess(*[F.lit(x).cast("int") for x in v]))
    assert [guess(1, 2, 2), guess(0, 2, 5), guess(0, 2, 12), guess(0, 3, 5), guess(None, None, None)] == ["monospace", "serif", "sans-serif", "sans-serif", "sans-serif"]
    assert one(spark, T.family_name(F.array(s("."), s(" Real ")), s("Folder"), s("stem"))) == "Real" and one(spark, T.family_name(F.array(s("")), s("--"), s("..."))) == "..."
    words = (("compressed", "mono", "x"), ("bold", "trial"))
    assert one(spark, T.file_qualifier(s("ZX Wide Trial"), s("ZX-Wide-X-Compressed-Bold-Trial"), *words)) == "X Compressed"
    assert one(spark, T.file_qualifier(s("ZX"), s("ZX-X-Bold"), *words)) is None and one(spark, T.file_qualifier(s("ZX"), s("ZX-Odd-Mono"), *words)) is None
    assert one(spark, T.pair_key(s("b"), s("a"))) == "a|b"


def test_eligibility(spark):
    rows = [(["cyrillic", "latin"], "Cyrl", True), (["latin", "korean"], "Kore", False), (["latin-ext", "greek"], "", False), (["latin"], "Hant", False), (["latin"], None, True), ([], "", False)]
    df = spark.createDataFrame(rows, "subsets array<string>, script string, want boolean")
    assert df.where(C.pairing_eligible(F.col("subsets"), F.col("script")) == F.col("want")).count() == len(rows)


def test_ladder(spark):
    df = spark.createDataFrame([("Widget", True, 100, 900, 400, True), ("Static", False, None, None, 500, False), ("Narrow", True, 450, 500, 480, False)], "family string, variable boolean, low int, high int, weight int, has_italic boolean")
    rows = sorted(map(tuple, C.expand_ladder(df).collect()))
    assert len([r for r in rows if r[0] == "Widget"]) == 8 and ("Static", 500, "normal") in rows and ("Narrow", 480, "normal") in rows


def test_served_instances_and_counts(spark):
    rows = [("A", 400, "normal", True), ("A", 700, "normal", True), ("B", 400, "italic", False), ("C", 400, "normal", True)]
    instances = spark.createDataFrame(rows, "family string, weight int, style string, eligible boolean")
    served = spark.createDataFrame([("A", 400, "normal"), ("B", 400, "italic"), ("B", 400, "italic"), ("Z", 400, "normal")], "family string, weight int, style string")
    assert sorted(r["family"] for r in C.served_only(instances, served).collect()) == ["A", "B"]
    assert C.release_counts(instances, served).first().asDict() == {"families": 3, "published": 3, "families_kept": 2, "unpublished": 1, "cuts_dropped": 2, "instances": 2, "eligible": 1}


def test_name_matching(spark, tiny):
    labels = spark.createDataFrame([("Alph",), ("Alpha",), ("Zeta",)], "label string")
    got = sorted(map(tuple, C.match_families(labels, tiny).collect()))
    assert got == [("Alph", "Alpha"), ("Alph", "Alpha Bold"), ("Alpha", "Alpha")]


def test_pick_cut(spark):
    rows = [(0, "Fam", 400, "normal"), (1, "Fam", 400, "italic"), (2, "Fam", 300, "normal"), (3, "Other", 400, "normal")]
    corpus = spark.createDataFrame(rows, "id long, family string, weight int, style string")
    wanted = spark.createDataFrame([(1, "Fam", 300, None), (2, "Fam", 400, None), (3, "Fam", 400, "italic"), (4, "Fam", None, None), (5, "Fam", 900, None)], "key int, family string, weight int, style string")
    got = {r["key"]: (r["id"], r["warned"]) for r in C.pick_cut(corpus, wanted).collect()}
    assert got == {1: (2, False), 2: (0, False), 3: (1, False), 4: (0, False), 5: (0, True)}


def test_guard_keeps_the_pool_of_a_light_heading(spark, tiny):
    heads = tiny.where("id in (0, 3)").withColumn("weight", F.when(F.col("id") == 0, 100).otherwise(F.col("weight")))
    kept = C.stroke_guard(C.pool(heads, tiny)).groupBy("h_id").count().collect()
    assert {r["h_id"]: r["count"] for r in kept} == {0: 3, 3: 3}


def test_merge(spark, tiny):
    both = C.merge(tiny.where("id < 2"), tiny.where("id < 2"))
    assert sorted((r["id"], r["source"]) for r in both.select("id", "source").collect()) == [(0, "google"), (1, "google"), (2, "private"), (3, "private")]


def test_ranks_and_metrics(spark):
    ranked = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 3, 3), (9, 1, 1)], "h_id long, id long, rank int")
    partners = spark.createDataFrame([(0, 2), (0, 77), (9, 1)], "h_id long, partner long")
    ranks = {(r["h_id"], r["partner"]): r["rank"] for r in E.partner_ranks(ranked, partners).collect()}
    assert ranks == {(0, 2): 2, (0, 77): 4, (9, 1): 1}
    heads = E.per_heading(E.partner_ranks(ranked, partners), 1)
    s = E.summary(heads, 1).first()
    assert (s["headings"], s["hit"], s["recall"], s["ndcg"], s["median_upper"], s["median_true"]) == (2, 1, 0.5, 0.5, 2, 1)
    counted = {(r["h_id"], r["partner"]): (r["rank"], r["pool"]) for r in E.ranks_by_count(ranked.select("h_id", "id", (-F.col("rank")).cast("double").alias("score")), partners).collect()}
    assert counted == {(0, 2): (2, 3), (0, 77): (4, 3), (9, 1): (1, 1)}
    roles = E.role_summary(heads.withColumn("role", F.when(F.col("h_id") == 0, "body").otherwise("head"))).collect()
    assert {r["role"]: (r["headings"], r["recall"]) for r in roles} == {"body": (1, 0.0), "head": (1, 1.0), None: (2, 0.5)}
    assert [E.upper_median(spark.createDataFrame([(float(x),) for x in v], "v double"), "v") for v in ([3, 1], [5, 1, 3], [2, 2, 2, 9], [])] == [3.0, 3.0, 2.0, None]
    empty = E.summary(heads.limit(0), 10).first()
    assert empty["headings"] == 0 and empty["hit"] == 0 and empty["median_upper"] is None


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 0), (0.0, 0), (2.0, 1)], "score double, label int")
    assert E.z_and_auc(df).first()["auc"] == (0.5 + 1 + 2) / 4


def test_mining(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a")], "row int, name string")
    sets = M.multi_rows(items, "row", "name")
    counted = M.uses(M.pair_rows(sets, "row", "name"))
    assert sorted(map(tuple, counted.collect())) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    lifts = {(r["a"], r["b"]): r["lift"] for r in M.lift(counted, M.support(sets, "name"), "name", 2).collect()}
    assert lifts == {("a", "b"): 1.0, ("a", "c"): 1.0, ("b", "c"): 1.0}
    labels = spark.createDataFrame([("H", "p"), ("H", "Zed"), ("G", "p")], "heading string, partner string")
    dropped = spark.createDataFrame([("G", None)], "heading string, partner string")
    matches = spark.createDataFrame([("H", "Fam"), ("p", "P1"), ("p", "P2")], "label string, family string")
    edges, missing = M.resolve_labels(labels, dropped, matches)
    assert sorted(map(tuple, edges.collect())) == [("Fam", "P1"), ("Fam", "P2")] and [r["label"] for r in missing.collect()] == ["Zed"]


def test_graph_scores(spark):
    units = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.0, 1.0]), (3, [0.8, 0.6])], "id long, unit array<double>")
    edges = spark.createDataFrame([(1, 2), (1, 3)], "heading long, partner long")
    partners = G.graph_partners(units.where("id = 0"), edges, units)
    scores = {r["id"]: (r["dsknn"], r["has_graph"]) for r in G.graph_scores(partners, spark.createDataFrame([(0, 2), (9, 2)], "h_id long, id long"), units).where("h_id = 0").collect()}
    assert scores[2][0] == pytest.approx((1.0 * 0.6 + 0.6 * 0.6) / 2) and scores[2][1] == 1


def test_role_terms(tiny):
    rows = {(r["h_id"], r["id"]): r for r in P.with_role_terms(P.with_products(C.pool(tiny, tiny))).withColumn("body", P.role_score("body")).withColumn("head", P.role_score("head")).collect()}
    r = rows[0, 1]
    assert r["body"] - r["head"] == pytest.approx(0.45) and r["gate"] == 1.0 and r["width_match"] == 0.0
    assert rows[1, 2]["cn"] == 1.0


def test_integrity(spark):
    df = spark.createDataFrame([(0, "google", bytearray(b"ab"), 1.0), (2, "private", bytearray(b"ab"), None)], "id long, source string, q binary, scale double").withColumn("q", F.array(F.lit(1), F.lit(2)))
    assert not I.dense_ids(df).first()["dense"]
    bad = {r["check"] for r in I.failures(df, {"count": 2, "dim": 3, "houseFaces": 0, "contracts": {"backbone": ["a", "b"]}}).collect()}
    assert bad == {"dim", "least dim", "scales", "ids", "source", "contract", "bytes", "pca"} - {"pca"}
    nested = {"grid": {"cols": 6, "size": 224}, "glyphs": "v1"}
    assert I.contract_differences(nested, {"grid": {"cols": 6, "size": 128}, "glyphs": "v1", "new": 1}) == ["grid.size", "new"] and I.contract_differences(nested, dict(nested)) == []
    more = {r["detail"] for r in I.failures(df.where("id = 0"), {"count": 1, "dim": 2, "houseFaces": 0, "catalog": 3, "bytes": 9, "pca": {"rows": 7}, "contracts": {"grid": [nested, {**nested, "glyphs": "v2"}]}}).collect()}
    assert more == {"2 is not 9", "3 is not 1", "7 is not 2", "grid.glyphs"}
    assert [tuple(r) for r in I.unlike_dims(df, df.withColumn("q", F.array(F.lit(1), F.lit(2), F.lit(3))), "q").collect()] == [(3, 2)] and I.unlike_dims(df, df, "q").count() == 0
    assert I.repeated_run(lambda: df, "id", "source").count() == 0
    a, b = I.content_hash(df, "id", "source"), I.content_hash(df.where("id = 0").withColumn("source", F.lit("x")), "id", "source")
    assert sorted(map(tuple, I.drifted(a, b, "id").collect())) == [(0, "changed"), (2, "added")]


def test_generator_against_its_sequence(spark):
    """One number after the other, as a generator with a state gives them."""
    for seed in (0, 42, 2**31 + 7):
        state, want = seed, []
        for _ in range(50):
            state = (state + 0x6D2B79F5) % 2**32
            t = (state ^ state >> 15) * (state | 1) % 2**32
            t = ((t + (t ^ t >> 7) * (t | 61)) % 2**32) ^ t
            want.append(t ^ t >> 14)
        assert [r["x"] for r in spark.range(50).orderBy("id").select(U.mulberry(F.col("id"), seed).alias("x")).collect()] == want


def test_null_draws(spark):
    weights = spark.createDataFrame([(1, 1), (2, 0), (3, 9)], "id long, weight long")
    n = {r["id"]: r["count"] for r in U.weighted_draws(weights, 2000).groupBy("id").count().collect()}
    assert sum(n.values()) == 2000 and 2 not in n and n[3] > 1600
    heavy = spark.createDataFrame([(i, 10**9 if i == 7 else 1) for i in range(50)], "id long, weight long")
    assert {r["id"] for r in U.weighted_draws(heavy, 500).collect()} == {7}
    drawn = U.uniform_pairs(spark.range(5), 4000).collect()
    assert len(drawn) == 4000 and all(r["a"] != r["b"] for r in drawn)
    counts = np.bincount([5 * r["a"] + r["b"] for r in drawn], minlength=25).reshape(5, 5)
    assert (counts[~np.eye(5, dtype=bool)] > 120).all() and U.uniform_pairs(spark.range(1), 10).count() == 0
    assert U.hashed_sample(spark.range(100), "id", 7).count() == 7 == U.hashed_sample(spark.range(100).repartition(5), "id", 7).join(U.hashed_sample(spark.range(100), "id", 7), "id").count()


def drawn(**boxes):
    """A sheet with rectangles (left, top, width, height) in the cells of glyphs; several of a glyph are given by a list."""
    image = np.full((R.SIZE, R.SIZE), 255, np.uint8)
    for glyph, parts in boxes.items():
        left, top, _, _ = R.cell_bounds(R.GLYPHS[glyph])
        for x, y, w, h in parts:
            image[top + y : top + y + h, left + x : left + x + w] = 0
    return image


def test_render_features(spark):
    assert R.runs(np.array([0, 1, 1, 0, 1], bool)).tolist() == [2, 1] and R.runs(np.zeros(3, bool)).tolist() == []
    assert R.cell_bounds(7) == (37, 56, 75, 112) and R.cell_center(7) == (56.0, 84.0)
    nothing = {"xh": None, "contrast": None, "aperture": None, "o_aspect": None}
    assert R.glyph_features(drawn()) == nothing == R.glyph_features(drawn(A=[(2, 4, 10, 40)]))
    # A from row 4 and n from row 16 down to the baseline at 44: 28 / 40; an o of strokes 6 wide and 3 high; an e open at the right in 9 of 28 rows
    image = drawn(A=[(2, 4, 10, 40)], n=[(2, 16, 10, 28)], o=[(2, 16, 28, 3), (2, 41, 28, 3), (2, 16, 6, 28), (24, 16, 6, 28)], e=[(2, 16, 20, 19), (2, 35, 8, 9)])
    found = R.glyph_features(image)
    assert found == {"xh": 0.7, "contrast": 0.5, "aperture": round(9 / 28, 4), "o_aspect": 1.0}
    assert R.legibility_of(1.0, 0.5, 0.0) == pytest.approx(2.5 / 3)
    rows = spark.createDataFrame([(1, bytearray(image.tobytes())), (2, bytearray(b"broken")), (3, None)], "id long, pixels binary")
    assert {r["id"]: r["xh"] for r in R.feature_rows(rows).collect()} == {1: 0.7, 2: None, 3: None}
    got = {r["id"]: r for r in R.embed_images(rows, R.stub_embedder(16)).collect()}
    assert len(got[1]["embedding"]) == 16 and got[1]["error"] is None and got[2]["embedding"] is None and got[2]["error"] and got[3]["error"]


def test_embedder_gets_batches_and_fails_alone(spark):
    images = [bytearray(np.full((R.SIZE, R.SIZE), i, np.uint8).tobytes()) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(images)), "id long, pixels binary").coalesce(1)

    def embedder(stack):
        if (stack[:, 0, 0] == 21).any():
            raise ValueError("cannot read 21")
        return np.column_stack([stack[:, 0, 0].astype(float), np.full(len(stack), float(len(stack)))])

    got = {r["id"]: r for r in R.embed_images(df, embedder).collect()}
    assert got[21]["embedding"] is None and "cannot read 21" in got[21]["error"]
    assert all(got[i]["embedding"][0] == i for i in range(40) if i != 21) and got[3]["embedding"][1] == 16 and got[20]["embedding"][1] == 1 and got[39]["embedding"][1] == 8


def test_preparation_modes():
    """Expectations from the published channel constants: blue first means 103.939 is taken from the first channel in both modes."""
    pixel = np.array([[[10, 100, 200]]], np.uint8)
    take = lambda mode: R.preprocess(pixel, mode)[:, 0, 0].tolist()
    assert take("caffe") == pytest.approx([200 - 103.939, 100 - 116.779, 10 - 123.68], abs=1e-4)
    assert take("rgb_mean") == pytest.approx([10 - 103.939, 100 - 116.779, 200 - 123.68], abs=1e-4)
    assert take("imagenet") == pytest.approx([(10 / 255 - 0.485) / 0.229, (100 / 255 - 0.456) / 0.224, (200 / 255 - 0.406) / 0.225], abs=1e-5)
    assert take("raw255") == [10, 100, 200] and take("raw01") == pytest.approx([10 / 255, 100 / 255, 200 / 255])
    with pytest.raises(ValueError):
        R.preprocess(pixel, "other")


def test_sheets_sizes_faces_and_spaces(spark):
    sheet = R.grid_image(lambda glyph, high: np.zeros((30, 10), np.uint8), "ab")
    left, top, right, _ = R.cell_bounds(1)
    assert (sheet[top + 14 : top + 44, left + 14 : left + 24] == 0).all() and (sheet < 128).sum() == 600 and sheet[top + 44, left + 15] == 255
    assert R.fitted_size(lambda px: (px * 3, px)) == (64, (16, 80)) and R.fitted_size(lambda px: (999, 1)) is None
    rows = [(0, "A", 400, "normal", True, "a"), (1, "A", 400, "normal", True, "a2"), (2, "B", 700, "normal", True, "b"), (3, "C", 400, "normal", False, "c"), (4, "D", 400, "normal", True, "gone")]
    instances = spark.createDataFrame(rows, "id long, family string, weight int, style string, eligible boolean, file string")
    wanted = spark.createDataFrame([(f,) for f in "ABCDE"], "family string")
    faces, missing = R.wanted_faces(instances, wanted, spark.createDataFrame([("a",), ("a2",), ("b",), ("c",)], "file string"))
    assert [tuple(r) for r in faces.collect()] == [("A", 0, "a")] and sorted(r["family"] for r in missing.collect()) == list("BCDE")
    pixels = [(i, bytearray(np.random.default_rng(i).integers(0, 255, 3 * 64, dtype=np.uint8).tobytes())) for i in range(3)] + [(9, None)]
    spaces = R.space_sweep(spark.createDataFrame(pixels, "id long, pixels binary"), lambda x: x.reshape(len(x), -1)[:, :5], size=8).collect()
    assert len(spaces) == 3 * 2 * 5 and all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-9 for r in spaces if r["scaled"])


def test_running_before(spark):
    from loomrank.operators.order import running_before

    rows = [(i, (i * 7919) % 50, i % 3) for i in range(500)]
    got = {r["id"]: r["before"] for r in running_before(spark.createDataFrame(rows, "id long, v long, n long"), "v", "id", F.col("n"), ranges=7).collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[i] == total
        total += n
    assert running_before(spark.createDataFrame([], "id long"), "id").count() == 0


def test_evenly_spaced_and_folds(spark):
    df = spark.range(10)
    assert sorted(r["id"] for r in E.evenly_spaced(df, "id", 4).collect()) == [0, 2, 5, 7]
    assert [r["fold"] for r in E.folds(df.withColumnRenamed("id", "h_id")).orderBy("h_id").collect()] == [0, 1] * 5


def test_shared_folder_is_the_sessions_own(spark, tmp_path, monkeypatch):
    """The configured folder, else the session's checkpoint folder; a cluster with neither is an error, local mode gets one."""

    class Context:
        def __init__(self, conf, known, master):
            self.conf, self.known, self.master, self.applicationId, self.set = conf, known, master, f"app-{conf}-{known}-{master}", []
            self._jsc = self

        sc = getConf = getCheckpointDir = lambda self: self
        isDefined = lambda self: self.known is not None
        setCheckpointDir = lambda self, path: self.set.append(path)

        def get(self, key=None):
            return self.conf if key else self.known

    folder = lambda *a: S.shared_folder(type("Session", (), {"sparkContext": Context(*a)})())
    assert folder("hdfs://one/", "file:/two", "yarn") == "hdfs://one" and folder(None, "file:/two", "yarn") == "file:/two"
    assert folder(None, None, "local[2]").startswith("file:///")
    with pytest.raises(ValueError, match="checkpoint"):
        folder(None, None, "spark://host:7077")
    rows = S.kept(spark.range(5).withColumn("x", F.lit("a")))
    assert rows.count() == 5 and rows.inputFiles() and rows.schema.simpleString() == "struct<id:bigint,x:string>"
