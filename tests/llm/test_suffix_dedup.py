import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrank.llm import _suffix, suffix_dedup


def brute(rows):
    seen = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for k, (_, raw) in enumerate(raws):
        for a in range(len(raw) - 199):
            seen.setdefault(raw[a : a + 200], []).append((k, a))
    gone = [np.zeros(len(raw) + 1, bool) for _, raw in raws]
    for places in seen.values():
        if len(places) > 1:
            for k, a in places:
                gone[k][a : a + 200] = True
    out = []
    for (i, raw), g in zip(raws, gone):
        kept = bytes(b for b, x in zip(raw, g) if not x)
        out.append((i, len(raw), int(g.sum()), int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def compare(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, key int, kept string").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.digests(suffix_dedup.remove_repeats(docs)).collect()), key=str)
    assert got == brute(rows)
    return got


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_documents_against_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert any(r[2] for r in compare(spark, rows))


@pytest.mark.parametrize("hot", [2_048, 3, 1])
def test_odd_rows(spark, monkeypatch, hot):
    """A small ``HOT`` deals the anchors at the edges of the passage by more content, level by level."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(2)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    edited = base[:250] + "#" + base[250:]
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "y" * 1000), (6, "ab" * 500), (7, base), (8, edited), (9, base[100:]), (10, base[:150] + passage + base[300:]), (11, passage), (11, passage), (None, prose(rng, 30) + passage + "!")]
    rows += [(20 + i, prose(rng, 20) + passage + prose(rng, 20)) for i in range(30)]
    rows += [(60, prose(rng, 3000) + passage + prose(rng, 3000)), (61, "z" * 201), (62, passage.encode()[:200].decode("utf-8", "ignore"))]
    rows += [(70 + i, base[: 20 * i] + str(i) + base[20 * i :]) for i in range(20)]
    compare(spark, rows)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    long = prose(rng, 900)
    data = np.frombuffer(long.encode(), np.uint8)
    whole = suffix_dedup._segments(data, np.array([0, len(data)]), ())
    cut = suffix_dedup.segments(data, np.array([0, len(data)]))
    assert set(whole[2].tolist()) == set(cut[2].tolist()) and (cut[1] - cut[0] + 1).sum() == len(data) - 199
    assert set(cut[5].tolist()) == set(whole[5].tolist())


def test_hot_anchors_are_dealt_by_the_bytes_of_their_windows():
    """With every key hot, parts are single windows, and equal keys mean equal windows."""
    rng = random.Random(5)
    core = prose(rng, 90)
    texts = [prose(rng, 5) + core[:n] + prose(rng, 40) for n in (240, 230, 400)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    every = lambda keys: np.ones(len(keys), bool)
    for levels, most in ((0, 73), (1, 10), (2, 1)):
        first, last, key, segment, level, _, number = suffix_dedup.segments(data, offsets, [every] * levels)
        assert (level == levels).all() and (last - first).max() < most and (last - first + 1).sum() == sum(len(t.encode()) - 199 for t in texts)
        assert all(offsets[n] <= f and e + 200 <= offsets[n + 1] for f, e, n in zip(first, last, number))
    raw = data.tobytes()
    assert len({(k, raw[f : f + 200]) for f, k in zip(first.tolist(), key.tolist())}) == len(set(key.tolist())) == len({raw[f : f + 200] for f in first.tolist()}) < len(first)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0


def shared(a, b):
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return min(n, _suffix.CAP)


@given(st.lists(st.integers(1, 4), max_size=200), st.integers(1, 4), st.sampled_from([(32 << 20, 1 << 17, 1 << 16), (0, 7, 96), (0, 64, 3)]))
@settings(max_examples=300, deadline=None)
def test_order_and_common_prefixes(values, times, bounds):
    """Against plain sorting, also where every array lies on disk and is worked on in small chunks and runs."""
    text = np.array([*(values * times), 0], dtype=np.int64)
    kept = _suffix.MEMORY, _suffix.CHUNK, _suffix.RUN
    _suffix.MEMORY, _suffix.CHUNK, _suffix.RUN = bounds
    try:
        order, prefixes = _suffix.suffixes(text)
    finally:
        _suffix.MEMORY, _suffix.CHUNK, _suffix.RUN = kept
    plain = [text[i:].tolist() for i in range(len(text))]
    want = sorted(range(len(text)), key=plain.__getitem__)
    assert order.tolist() == want
    assert prefixes.tolist() == [0, *(shared(plain[a], plain[b]) for a, b in zip(want, want[1:]))]


@given(st.lists(st.integers(0, 254), min_size=1, max_size=300), st.data())
@settings(max_examples=100, deadline=None)
def test_range_minima(values, data):
    array = np.array(values, np.uint8)
    least = _suffix.RangeMin(array)
    for upto in sorted(data.draw(st.lists(st.integers(0, len(values)), max_size=3))):
        least.extend(upto)
    pairs = data.draw(st.lists(st.tuples(st.integers(0, len(values)), st.integers(0, len(values))), max_size=20))
    a, b = np.array([min(p) for p in pairs], np.int64), np.array([max(p) for p in pairs], np.int64)
    least.extend(len(values))
    assert least.query(a, b).tolist() == [min(values[x:y], default=_suffix.NONE) for x, y in zip(a, b)]
    some = [(x, y) for x, y in zip(a, b) if x < y]
    if some:
        x, y = map(np.array, zip(*some))
        assert _suffix._table_min(array, x - 1, y - 1).tolist() == [min(values[i:j]) for i, j in some]


def test_repeated_windows():
    rng = random.Random(9)
    core = bytes(rng.randrange(256) for _ in range(300))
    parts = [core[:250], b"xx" + core[20:260], bytes(rng.randrange(256) for _ in range(260)), b"\0" * 205]
    got = suffix_dedup.repeated_windows(parts)
    assert [np.flatnonzero(g).tolist() for g in got] == [list(range(20, 51)), list(range(2, 33)), [], list(range(6))]
