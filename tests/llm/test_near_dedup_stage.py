import random
from collections import Counter
from itertools import combinations

import corpus_pipeline

from loomrank.llm import minhash
from tests.llm.test_minhash import shingles, words


def kept_ids(rows, percent):
    """The ids that stay, by comparing every two documents that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    common = Counter(pair for ids in where.values() for pair in combinations(sorted(ids), 2))
    near = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    parent = {}

    def root(i):
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    for a, b in near:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return sorted(i for i in sets if root(i) == i)


def test_stage_against_brute_force_at_80(spark, sf_dir):
    rng = random.Random(8)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r[c] for c in docs.columns) for r in docs.collect()]
    begin = max(r[0] for r in rows) + 1
    between = below = 0
    for k in range(60):  # words changed so that similarities lie from 0.77 to 0.84
        base = words(rng, 500)
        copy = list(base)
        for at in range(7, 500, 40 + k % 15):
            copy[at] = "edit" + str(at)
        pair = [" ".join(base), " ".join(copy)]
        a, b = map(shingles, pair)
        between += 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
        below += 100 * len(a & b) < 80 * len(a | b)
        rows += [(begin + 2 * k + j, t, "en", "s", len(t)) for j, t in enumerate(pair)]
    assert between >= 20 and below >= 5
    kept = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, docs.schema), sf_dir)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == kept_ids([r[:2] for r in rows], 80)


def test_bands_follow_the_similarity():
    for percent, want in ((85, 8), (80, 6)):
        rows = minhash.band_rows(percent)
        assert rows == want and (1 - (percent / 100) ** rows) ** (minhash.SLOTS // rows) < 1e-4
