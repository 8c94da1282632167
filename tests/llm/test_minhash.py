import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrank.llm import minhash
from loomrank.llm._graph import union_find
from loomrank.llm._text import string_slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """doc_id -> (set size, component) by comparing every two documents that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    common = defaultdict(int)
    for ks in where.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 85 * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(s), least[root(k)]) for k, (i, s) in enumerate(sets)}


def compare(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    for i, (n, c) in want.items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c), i


def words(rng, n):
    return [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(n)]


def test_groups_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(30):
        base = words(rng, rng.randint(3, 400))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randint(0, 9999))
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy).upper()))
    # copies that are near the base but not near each other, the base last
    base = words(rng, 300)
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(300), 4):
            copy[at] = "x" + str(rng.randint(0, 9999))
        rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), " ".join(base)))
    compare(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One  two"), (6, "two one"), (7, long), (8, long + " tail"), (9, "a b c d e"), (10, "a b c d e f"), (11, "İ K café x y z"), (12, "İ K café X Y Z")]
    compare(spark, rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, "k"), (1, "a b c d e f", 7, "k"), (None, "q r s t u v", 7, "k"), (None, "q r s t u v", 7, "k")], "doc_id long, text string, component_id int, node string")
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("None", "None", True), ("None", "None", True)]
    assert sorted(str(r["doc_id"]) for r in minhash.drop_near_duplicates(docs).collect()) == ["1", "None", "None"]
    assert minhash.drop_near_duplicates(docs).columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(docs).count() == 0


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (40, 300, 3000):
        a = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
        b = a.copy()
        b[: n // 10] = rng.integers(0, 2**63, n // 10, dtype=np.int64).astype(np.uint64)
        sig = minhash.superminhash([np.unique(a), np.unique(b), np.unique(a)])
        assert (sig[0] == sig[2]).all()
        assert abs((sig[0] == sig[1]).mean() - (0.9 / 1.1)) < 0.08


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=60, deadline=None)
def test_union_find(edges):
    a = np.array([x for x, _ in edges], dtype=np.int64)
    b = np.array([y for _, y in edges], dtype=np.int64)
    nodes, roots = union_find(a, b)
    near = {int(n): {int(n)} for n in nodes}
    for x, y in edges:
        merged = near[x] | near[y]
        for z in merged:
            near[z] = merged
    assert {int(n): int(r) for n, r in zip(nodes, roots, strict=True)} == {n: min(s) for n, s in near.items()}


def test_sets_do_not_cross_texts():
    import pyarrow as pa

    for _, _, data, offsets in string_slices(pa.array(["a b c", "d e f g h", None, "a b c"])):
        sets = minhash.shingle_sets(data, offsets)
        assert [len(s) for s in sets] == [1, 1, 0, 1] and sets[0][0] == sets[3][0]
