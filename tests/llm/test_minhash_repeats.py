import random

from loomrank.llm import minhash
from tests.llm.test_minhash import brute, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copy(rng, base, edits):
    copy = list(base)
    for at in rng.sample(range(len(base)), edits):
        copy[at] = "edit" + str(rng.randint(0, 9999))
    return copy


def test_repeated_rows_in_unsettled_buckets(spark, monkeypatch):
    # no hub finds an edge, so that all buckets stay unsettled and only the exact search can link
    verified, calls = minhash._verified, []

    def none_first(*args):
        calls.append(1)
        return verified(*args).limit(0) if len(calls) == 1 else verified(*args)

    monkeypatch.setattr(minhash, "_verified", none_first)
    rng = random.Random(3)
    rows = []
    for k in range(8):
        base = words(rng, 300)
        rows += [(10 * k, " ".join(base))] * 20 + [(10 * k + 1, " ".join(near_copy(rng, base, 3)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert len(calls) == 2 and got == {i: c for i, (_, c) in brute(sorted(set(rows))).items()}
    assert sum(got[10 * k + 1] == 10 * k for k in range(8)) >= 6


def test_ids_shared_by_different_texts(spark):
    rng = random.Random(4)
    a, b, c = (words(rng, 200) for _ in range(3))
    text = {name: " ".join(w) for name, w in (("a", a), ("b", b), ("b2", near_copy(rng, b, 1)), ("c", c), ("c2", near_copy(rng, c, 1)))}
    names = [(5, "a"), (5, "a"), (5, "b"), (3, "b2"), (7, "a"), (8, "c"), (8, "c2"), (9, "c")]
    docs = spark.createDataFrame([(i, text[n], n, "s", 0) for i, n in names] + [(6, "", "empty", "s", 0), (6, None, "null", "s", 0)], DOCS)
    got = sorted((r["doc_id"], r["lang"]) for r in minhash.drop_near_duplicates(docs).collect())
    assert got in ([(3, "b2"), (5, "a"), (6, "empty"), (6, "null"), (8, x)] for x in ("c", "c2"))
