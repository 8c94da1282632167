import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrank.llm import quality
from loomrank.llm._sample import kth_largest


@pytest.fixture(scope="module")
def tables(spark):
    at = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_held_out_labels(spark, tables):
    docs, labels = tables
    train = labels.where("doc_id % 2 = 0")
    got = {r["doc_id"]: r for r in quality.quality_weights(docs, train).collect()}
    assert len(got) == docs.count()
    held = labels.where("doc_id % 2 = 1").collect()
    good = [got[r["doc_id"]]["kept"] for r in held if r["quality"] == 1]
    bad = [got[r["doc_id"]]["kept"] for r in held if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_the_largest_sums_stay(spark, tables):
    docs, labels = tables
    rows = quality.quality_weights(docs, labels).collect()
    kept = [r["gumbel_key"] for r in rows if r["kept"]]
    assert min(kept) > max(r["gumbel_key"] for r in rows if not r["kept"])
    noise = np.array([r["gumbel_key"] - r["log_weight"] for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.15 and abs(noise.var() - 1.6449) < 0.4


def test_selection_keeps_columns_and_agrees(spark, tables):
    docs, labels = tables
    kept = {r["doc_id"] for r in quality.quality_weights(docs, labels).where("kept").collect()}
    chosen = quality.select_quality(docs, labels)
    assert chosen.columns == docs.columns and {r["doc_id"] for r in chosen.collect()} == kept


def test_weights_against_a_plain_count(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a b", "c d", None, "", "  ", "a b c"])], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    from loomrank.llm._sample import labelled_sample

    ratios = quality.log_ratios(docs, labelled_sample(labels, "quality"))
    import pyarrow as pa
    from loomrank.llm._text import string_slices

    def count(texts):
        total = np.zeros(quality.FEATURES)
        for _, _, data, offsets in string_slices(pa.array(texts, pa.string())):
            np.add.at(total, quality.features(data, offsets)[0], 1)
        return total

    raw, target = count(["a b a b", "c d", "a b c"]), count(["a b a b"])
    assert np.allclose(ratios, np.where(raw > 0, np.log(np.maximum((target / target.sum() + raw / raw.sum()) / 2, 1e-12)) - np.log(np.maximum(raw / raw.sum(), 1e-12)), 0))
    got = {r["doc_id"]: r["log_weight"] for r in quality.quality_weights(docs, labels).collect()}
    assert got[2] == got[3] == got[4] == 0


MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_features(text):
    """Hashed words, word pairs, shapes and shape pairs of a text, one word at a time."""
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    upper, lower, digit = (lambda b: 65 <= b <= 90), (lambda b: 97 <= b <= 122 or b >= 128), (lambda b: 48 <= b <= 57)
    hashes, shapes = [], []
    for i, w in enumerate(words):
        total = sum((b + 1) * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j, b in enumerate(w)) & MASK
        hashes.append(plain_mix(total ^ len(w) * 0xD6E8FEB86659FD93 & MASK))
        kinds = [sum(map(f, w)) for f in (upper, lower, digit)]
        mark = 0 if any(f(w[-1]) for f in (upper, lower, digit)) else w[-1]
        head = 1 if upper(w[0]) else 2 if lower(w[0]) else 3 if digit(w[0]) else w[0]
        again = sum(2**back // 2 for back in (1, 2) if i >= back and words[i - back] == w)
        shape = 0
        for part in (0 if not kinds[0] else 2 if not kinds[1] else 1, min(kinds[2], 3), min(len(w) - sum(kinds), 4), mark, head, again, min(len(w), 2)):
            shape = plain_mix(shape ^ (part + 0x100))
        shapes.append(shape)
    pairs = lambda xs: [plain_mix(a * 3 & MASK ^ b) for a, b in zip(xs, xs[1:])]
    return [plain_mix(h ^ salt << 56) % quality.FEATURES for salt, part in enumerate((hashes, pairs(hashes), shapes, pairs(shapes)), 1) for h in part]


def test_selection_against_plain_python(spark):
    """Models, weights, noise, cut and the rows that stay, worked out one document at a time."""
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    extra = [(10**6, None, None), (10**6 + 1, "", 1), (10**6 + 2, "ONE one ONE one 2x! 2x!", 0), (10**6 + 2, "ONE one ONE one 2x! 2x!", None)]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t, _ in extra], "doc_id long, text string"))
    labels = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(i, q) for i, _, q in extra], "doc_id long, quality long"))
    label = {}
    for r in labels.collect():
        if r["quality"] is not None:
            label[r["doc_id"]] = max(r["quality"], label.get(r["doc_id"], 0))
    rows = docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("tuning"), F.xxhash64("doc_id").alias("hash")).collect()
    found = [plain_features(r["text"]) for r in rows]
    raw, target = Counter(), Counter()
    for r, f in zip(rows, found):
        raw.update(f)
        if label.get(r["doc_id"]) == 1 and not r["tuning"]:
            target.update(f)
    n, m = sum(raw.values()), sum(target.values())
    ratio = {f: math.log((target[f] + m * c / n) / (2 * m)) - math.log(c / n) for f, c in raw.items()}
    weight = [200 * sum(ratio[x] for x in f) / max(len(f), 1) for f in found]
    key = [w - math.log(-math.log(((plain_mix(r["hash"] & MASK) >> 11) + 0.5) / 2**53)) for w, r in zip(weight, rows)]
    seen = sorted((w, label[r["doc_id"]]) for w, r in zip(weight, rows) if r["tuning"] and r["doc_id"] in label)
    good = sum(q for _, q in seen)
    cuts = [-math.inf, *((a + b) / 2 for (a, _), (b, _) in zip(seen, seen[1:])), math.inf]
    lost = [sum(q for _, q in seen[:i]) for i in range(len(cuts))]
    wrong = [lost[i] + sum(1 - q for _, q in seen[i:]) if lost[i] <= (1 - quality.KEEP_GOOD) * good else math.inf for i in range(len(cuts))]
    cut = cuts[wrong.index(min(wrong))]
    least = sorted(key, reverse=True)[sum(w >= cut for w in weight) - 1]
    got = sorted((r["doc_id"], r["log_weight"], r["gumbel_key"], r["kept"]) for r in quality.quality_weights(docs, labels).collect())
    want = sorted((r["doc_id"], w, k, k >= least) for r, w, k in zip(rows, weight, key))
    assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]
    assert np.allclose([g[1:3] for g in got], [w[1:3] for w in want], rtol=1e-9, atol=1e-9)
    assert 0 < sum(w[3] for w in want) < len(want)


def test_selection_passes_columns_of_any_name(spark, tables):
    docs, labels = tables
    named = docs.withColumns({"_hash": F.lit("x"), "_HASH_": F.lit(1), "label": F.lit(None).cast("string"), "bits": F.lit(2)})
    chosen = quality.select_quality(named, labels)
    assert chosen.columns == named.columns and {r["doc_id"] for r in chosen.collect()} == {r["doc_id"] for r in quality.select_quality(docs, labels).collect()}
    assert {(r["_hash"], r["_HASH_"], r["label"], r["bits"]) for r in chosen.collect()} == {("x", 1, None, 2)}


def test_no_labels_nulls_and_empty(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert [r["kept"] for r in quality.quality_weights(docs, labels).collect()] == [True] * 3
    assert quality.quality_weights(docs.limit(0), labels).count() == 0
    assert quality.select_quality(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("k", [1, 2, 50, 199, 200])
def test_kth_largest(spark, k):
    values = np.random.default_rng(k).integers(-(2**62), 2**62, 100).tolist() + list(range(-50, 50))
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
