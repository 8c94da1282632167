import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hypothesis import given
from hypothesis import strategies as st

from loomrank.llm import _shared_arrays, lm
from loomrank.llm._shared_arrays import SharedArrays, narrow, widened


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def plain(rows, order=lm.ORDER):
    """The contract and the model by dictionaries."""
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows}
    count, grams = Counter(), {n: Counter() for n in range(2, order + 1)}
    for i, t in rows:
        if not held[i]:
            seen = ["start"]
            for w in words(t):
                count[w] += 1
                seen.append((w,))
                for n in grams:
                    if len(seen) >= n:
                        grams[n][tuple(seen[-n:])] += 1
    adjusted = {order: dict(grams[order])}
    for n in range(2, order):
        kinds = Counter(g[1:] for g in grams[n + 1])
        adjusted[n] = {g: c if g[0] == "start" else kinds[g] for g, c in grams[n].items()}
    kinds = Counter(g[1][0] for g in grams[2])

    def discount(values):
        t = [sum(c == i for c in values) for i in (1, 2, 3, 4)]
        if not t[0] or not t[1]:
            return [0, 0.5, 0.5, 0.5]
        y = t[0] / (t[0] + 2 * t[1])
        return [0] + [min(max(i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] else 0.5 * i, 0), i) for i in (1, 2, 3)]

    below = {n: defaultdict(list) for n in grams}
    for n in grams:
        for g, c in adjusted[n].items():
            below[n][g[:-1]].append(c)
    d, dw = {n: discount(adjusted[n].values()) for n in grams}, discount(kinds.values())
    n, v, b = sum(count.values()), len(count), len(grams[2])
    spread = sum(dw[min(k, 3)] for k in kinds.values()) / b if b else 1

    def p(before, w):
        if not before:
            base = 1 / (v + 1)
            return max(kinds[w] - dw[min(kinds[w], 3)], 0) / b + spread * base if b else base
        lower, own = p(before[1:], w), below[len(before) + 1][before]
        if not sum(own):
            return lower
        dn, c = d[len(before) + 1], adjusted[len(before) + 1].get((*before, (w,)), 0)
        return (max(c - dn[min(c, 3)], 0) + sum(dn[min(x, 3)] for x in own) * lower) / sum(own)

    out = []
    for i, t in rows:
        ws = words(t)
        score, before = 0.0, ("start",)
        for w in ws:
            score += math.log10(p(before, w))
            before = (*before, (w,))[-(order - 1) :]
        out.append((i, held[i], len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), score))
    return out, p, set(count)


def compare(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9)


def test_documents_against_dictionaries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    compare(lm.lm_scores(docs).collect(), plain(rows)[0])


@pytest.mark.parametrize("order,hot", [(2, 2_000_000), (3, 2_000_000), (3, 5), (4, 5)])
def test_odd_rows(spark, monkeypatch, order, hot):
    """A small ``HOT`` deals frequent words, phrases and the start mark over units of their own."""
    monkeypatch.setattr(lm, "GATHER", 50)
    monkeypatch.setattr(lm, "HOT", hot)
    texts = [None, "", " \n", "a b a b a", "A  b\tA", "é 日本 é", "a b c d e f g " * 2000, "unseen words here", "a b", "a b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "a b c")]
    docs = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, bucket int").repartition(3)
    compare(lm.lm_scores(docs, order=order).collect(), plain(rows, order)[0])


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in lm.lm_scores(docs).collect()} == {(0, 0, 0.0, 0.0)}
    assert lm.lm_scores(docs.limit(0)).count() == 0


def test_probabilities_sum_to_one():
    rows = [(i, " ".join(chr(97 + (i * j) % 7) for j in range(1, 12))) for i in range(1, 40)]
    _, p, vocabulary = plain(rows)
    for before in (("start",), ("start", ("a",)), (("a",), ("b",)), (("c",), ("a",)), (("zzz",), ("a",)), (("zzz",),)):
        assert sum(p(before, w) for w in vocabulary) + p(before, "unknown") == pytest.approx(1)


def test_shared_arrays(tmp_path, monkeypatch):
    monkeypatch.setattr(_shared_arrays, "OPEN", 1)
    store = SharedArrays(f"file://{tmp_path}/deep")
    store.write("x-1", a=np.arange(5, dtype=np.uint64))
    store.write("x-1", a=np.arange(6, dtype=np.uint64), b=np.array([1, 2, 3], np.uint8))
    store.write("x-2", a=np.zeros(0, np.uint64))
    for _ in range(2):
        assert store.read("x-1")["a"].tolist() == list(range(6)) and store.read("x-1")["b"].tolist() == [1, 2, 3] and len(store.read("x-2")["a"]) == 0
    assert len(store._open) == 1


def test_remote_store_is_mapped_from_a_private_copy(tmp_path, monkeypatch):
    """Any store but a file path goes through pyarrow's file systems."""
    from pyarrow import fs

    monkeypatch.setattr(SharedArrays, "_remote", lambda self: (fs.LocalFileSystem(), f"{tmp_path}/far"))
    store = SharedArrays("other://host/far")
    assert store.local is None
    store.write("x", a=np.arange(1000, dtype=np.int64), b=np.zeros(0, np.uint8))
    assert store.read("x")["a"].tolist() == list(range(1000)) and not len(store.read("x")["b"])
    assert [f.name for f in (tmp_path / "far").iterdir()] == ["x"]


@given(st.lists(st.sampled_from([0, 1, 254, 255, 256, 2**32, 2**62]), max_size=20))
def test_narrow_values_come_back(values):
    group = narrow("n", np.array(values, np.int64))
    assert widened(group, "n", np.arange(len(values))).tolist() == values
    assert widened(group, "n", slice(3, None)).tolist() == values[3:]


def test_words_are_hashed_in_pieces_of_whole_texts(monkeypatch):
    """A slice's words were hashed at once, over powers too long to be kept; pieces give the same tokens."""
    texts = ["a b  c", "", "d" * 50, " e\tF ", "g h i j k"] * 7
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole, sizes, hashed = lm.tokens(data, offsets), [], lm.word_hashes
    monkeypatch.setattr(lm, "HASHED", 20, raising=False)
    monkeypatch.setattr(lm, "word_hashes", lambda d, o: (sizes.append((len(d), len(o) - 1)), hashed(d, o))[1])
    assert all((a == b).all() for a, b in zip(whole, lm.tokens(data, offsets)))
    assert len(sizes) > 1 and all(size <= 20 or count == 1 for size, count in sizes)


def test_wide_and_narrow_ranges_are_searched_alike():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 300, 3, 0, 40, 7]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    values = np.concatenate([np.sort(rng.choice(400, s, replace=False)) for s in sizes]).astype(np.uint16)
    context, wanted = np.sort(rng.integers(0, len(sizes), 400)), rng.integers(-1, 70_000, 400)
    wanted[::2] %= 400
    got = lm._within(values, begin[context], begin[context + 1], wanted)
    want = [next((i for i in range(begin[c], begin[c + 1]) if values[i] == w), -1) for c, w in zip(context, wanted)]
    assert got.tolist() == want and (got >= 0).any()
