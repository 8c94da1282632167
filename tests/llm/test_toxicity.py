import math
import unicodedata
import zlib
from collections import Counter

import numpy as np

from loomrank.llm import toxicity
from loomrank.llm.toxicity import Lexicon, bare, fold


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]]) for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    y = np.array([t for t, _ in held])
    s = np.array([g["score"] for _, g in held])
    p = np.array([g["predicted"] for _, g in held])
    order = np.argsort(s)
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    print("held out", len(y), "auc", auc, "recall", p[y == 1].mean(), "false positives", p[y == 0].mean())
    assert auc > 0.93 and p[y == 1].mean() > 0.8 and p[y == 0].mean() < 0.05


def test_fold():
    assert fold("Ідiоt, 1D10T!") == " ідiot idiot ".replace("ід", "iд")
    assert fold("l\u200bo\u00adser") == " loser " and fold("ｌｏｓｅｒ") == " loser "
    assert fold("you idiot!") == " you idiot " and fold("paid $100, 3 times! (4)") == " paid times "
    assert fold("sh1t $cum @ss idi0t! wh4t!? a55") == " shit scum ass idiot what a "
    assert fold("ídïòt e\u0301a x\u0332y") == " ídïòt éa xy " and [bare(w) for w in ("ídïòt", "éa", "plain", "日本")] == ["idiot", "ea", "plain", "日本"]
    assert fold("wow!!great a|b") == " wowiigreat alb "
    assert fold(None) == fold("") == fold(" .,- ") == "  "


def test_hits_exceptions_and_length():
    lexicon = Lexicon({" scum": 2.0, " scum ": 3.0}, {"pond scum"}, (-2.0, 1.0, 1.0))
    assert lexicon.hits(fold("Scum scummy")) == {0: 3.0, 5: 2.0}
    assert lexicon.hits(fold("pond 5cum is scum")) == {fold("pond scum is").rindex(" "): 3.0}
    assert lexicon.hits(fold("é sçum sčummy ü")) == {2: 3.0, 7: 2.0} and lexicon.hits(fold("pönd scúm")) == {}
    short, long = lexicon.score(["you scum", "you scum " + "word " * 500])
    assert short > long > lexicon.score(["nothing"])[0] == lexicon.score([None])[0]


def test_learned_exceptions_and_odd_rows(spark):
    rows = [(i, f"a{'bc'[i % 2]}d you jerk number") for i in range(200)] + [(200 + i, "the soda jerk works and talks " + "plain words follow " * 3) for i in range(20)] + [(300 + i, "plain text with words") for i in range(200)]
    docs = spark.createDataFrame([(i, t, 9, "s") for i, t in [*rows, (None, None), (7000, ""), (7000, "")]], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels)
    assert any("soda jerk" == e for e in lexicon.exceptions)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
    assert all(by[i]["predicted"] == int(i < 200) for i, _ in rows)
    assert by[None]["score"] == by[7000]["score"] < 0.3
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("toxic = 1")).collect()} == {1.0}


def plain_fold(text):
    """Folding one character at a time."""
    low = "".join(c for c in unicodedata.normalize("NFKC", (text or "").lower()) if not unicodedata.combining(c)).lower()
    low = "".join(toxicity.HOMOGLYPHS.get(c, c) for c in low if c not in toxicity.ZERO_WIDTH)
    letter = lambda c: c.isalnum() and not c.isnumeric() or c.isalpha()
    out, i = [], 0
    while i < len(low):
        j = i
        while j < len(low) and low[j] in toxicity.STAND_INS:
            j += 1
        if j == i:
            out.append(low[i] if letter(low[i]) else " ")
            i += 1
            continue
        run, before, after = low[i:j], low[i - 1] if i else " ", low[j] if j < len(low) else " "
        begins = not (before.isalnum() or before == "_") and all(c.isdigit() or c in "@$" for c in run)
        out += [toxicity.STAND_INS[c] for c in run] if letter(after) and (letter(before) or begins) else " " * len(run)
        i = j
    return " ".join("".join(out).split())


def test_scores_against_plain_python(spark):
    """Lexicon, exceptions, measures and scores worked out with strings and dictionaries; only the logistic fit is checked by its gradient."""
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    label = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in text}
    folded = {i: plain_fold(t).split() for i, t in text.items()}
    without = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))
    entries = lambda w: {e for x in {w, without(w)} for e in [f" {x[:n]}" for n in range(4, 11) if n <= len(x)] + [f" {x} "]}
    hits, texts, words = {0: Counter(), 1: Counter()}, Counter(), Counter()
    for i, y in label.items():
        words[y] += len(folded[i])
        for w, n in Counter(folded[i]).items():
            for e in entries(w):
                hits[y][e] += n
        if y:
            texts.update({e for w in folded[i] for e in entries(w)})
    weights = {}
    for e, n in hits[1].items():
        expected = (hits[0][e] + 0.5) * words[1] / words[0]
        if texts[e] >= 5 and math.log((n + 0.5) / expected) >= 1.5 and (n - expected) / math.sqrt(expected + 1) >= 6:
            weights[e] = round(math.log((n + 0.5) / expected), 6)

    def matched(ws, spared=frozenset()):
        out = [max([weights[e] for e in entries(w) if e in weights], default=None) for w in ws]
        for k in range(len(ws) - 1):
            if f"{ws[k]} {ws[k + 1]}" in spared or f"{without(ws[k])} {without(ws[k + 1])}" in spared:
                out[k] = out[k + 1] = None
        return out

    around = {0: Counter(), 1: Counter()}
    for i, y in label.items():
        ws = folded[i]
        m = matched(ws)
        around[y].update({f"{a} {b}" for k, (a, b) in enumerate(zip(ws, ws[1:])) if m[k] is not None or m[k + 1] is not None})
    share = sum(label.values()) / len(label)
    spared = {p for p, n in around[0].items() if n >= 5 and around[1][p] <= share * n}
    lexicon = toxicity.train(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2"))
    assert lexicon.weights == weights and lexicon.exceptions == spared

    def measures(i):
        total, n = sum(w for w in matched(folded[i], spared) if w is not None), max(len(folded[i]), 1)
        return [1.0, total / math.sqrt(n), math.log1p(100 * total / n)]

    x, y = np.array([measures(i) for i in label]), np.array(list(label.values()), float)
    w = np.array(lexicon.fit)
    gradient = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - 1e-3 * math.sqrt(len(y)) * w
    assert (w[1:] >= 0).all() and all(abs(g) < 1e-5 or (v == 0 and g < 0) for g, v in zip(gradient, w))
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    want = {i: 1 / (1 + math.exp(-float(np.dot(measures(i), w)))) for i in text}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
