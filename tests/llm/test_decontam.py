import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomrank.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        w = words(text)
        hit, who = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    who |= windows[key]
        out.append((doc, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(str(i) for i in who if i is not None)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def hit_documents(rows, items):
    return {r[0] for r in brute(rows, items) if r[5]}


def test_documents_against_brute_force(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in decontam.contamination(docs, items).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert any(r[5] for r in got)


LONG = " ".join(f"w{i}" for i in range(30))
TAIL = " ".join(f"w{i}" for i in range(7, 16))
TEXTS = [None, TAIL, TAIL + " w16", "w3 " + TAIL + " w17 " + " ".join(f"w{i}" for i in range(11, 30)), "a b " * 40, "a " * 30, "", "...", LONG, LONG.upper().replace(" ", ", "), "x " + LONG + " y " + LONG, "Hello, WORLD!", "hello worlds", "say hello-world é日本 x", "É hello", "a" * 100_000 + " hello world " + "b " * 50_000, "w0 w1 w2 w3 w4 w5 w6 w7 w8"]
ITEMS = [(1, LONG), (2, "hello world"), (2, "hello world"), (10, "É日本"), (11, None), (12, " ., "), (None, "b b"), (13, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (14, "a b " * 9), (15, "a " * 14), (16, "a " * 14 + "b"), (17, LONG + " " + LONG)]


@pytest.mark.parametrize("slice_bytes", [1, 1 << 20])
def test_odd_rows(spark, monkeypatch, slice_bytes):
    """With slices of a byte there is one automaton an item; texts are held while they change."""
    monkeypatch.setattr(decontam, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(decontam, "HELD_BYTES", 300)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, LONG)]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in rows], "doc_id long, text string, hits int, contaminated boolean")
    items = spark.createDataFrame([(i, t, "z") for i, t in ITEMS], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in decontam.contamination(docs, items).collect()), key=str)
    assert got == brute(rows, ITEMS)
    kept = decontam.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in got if not r[5])


def test_original_offsets(spark):
    text = "É! Hello,\n WORLD é"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "hello world")], "item_id long, text string")
    (hit,) = decontam.find_hits(docs, items).collect()[0]["hits"]
    assert text[hit["start"] : hit["end"]] == "Hello,\n WORLD" and hit["item"] == "7"


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=24), max_size=4), st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 12))
@settings(max_examples=300, deadline=None)
def test_runs_are_the_union_of_windows(items, words, window):
    scanner = decontam.Scanner([(str(i), " ".join(w)) for i, w in enumerate(items)], window)
    n, hits = scanner.scan(" ".join(words))
    got = {str(i): set() for i in range(len(items))}
    for a, b, item in hits:
        got[item] |= set(range(a, b))
    for i, own in enumerate(items):
        size = min(window, len(own))
        grams = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if own else set()
        assert got[str(i)] == {k + j for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in grams for j in range(size)}
    assert n == len(words)


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.contamination(docs, none).where("contaminated").count()
    assert decontam.decontaminate(docs, none).count() == docs.count()
    assert decontam.contamination(docs.limit(0), none).count() == 0
