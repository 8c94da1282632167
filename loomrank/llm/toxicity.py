"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers case, maps homoglyphs of other scripts to Latin letters, drops zero-width characters and reads
a digit or sign as the letter it looks like where it stands between letters, or begins a word before a letter;
everything else becomes single spaces. A word with accents is read as it is and without them. The lexicon is
learned from a bounded sample of labelled rows: word beginnings and whole words that toxic texts use far more
often, each weighted by the log ratio of its rates. A word counts once, with its heaviest entry;
occurrences inside exception phrases (given, or learned as phrases with an entry that clean texts use) count
nothing. The sum of weights is normalised by length and turned into a probability by a logistic fit on the
same sample.

Results for odd input: a null or wordless text has no match and gets the score of a text without one;
where all labels have one value that value is every score (0 without labels); repeated rows are scored
each; a null id counts as the text '' in the split; an empty table gives an empty result; labels, language,
source and id never enter a score; other columns are ignored. Whole texts are scanned.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import trimmed, written
from ._sample import labelled_sample

#: Letters of other scripts that look like Latin ones, and digits and signs that stand in for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x",
}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

#: Lengths of word beginnings that may become entries, in letters; whole words of any length may.
PREFIXES = range(4, 11)
#: An entry stands in this many toxic texts of the sample at least, ...
MIN_TEXTS = 5
#: ... its rate there is at least e**MIN_WEIGHT times that in clean texts, and its surplus this many deviations.
MIN_WEIGHT, MIN_DEVIATIONS = 1.5, 6.0
#: Clean texts that a phrase stands in before it becomes an exception.
MIN_PHRASE = 5

_TABLE = str.maketrans({**HOMOGLYPHS, **dict.fromkeys(map(ord, ZERO_WIDTH))})
_MARKS = re.compile("[\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_LOOKS = re.compile(f"[{''.join(HOMOGLYPHS)}{ZERO_WIDTH}]")
#: a run of digits and signs before a letter
_RUN = re.compile(rf"[{''.join(map(re.escape, STAND_INS))}]+(?=[^\W\d_])")
_LETTER = re.compile(r"[^\W\d_]")
_BEGINS = frozenset(c for c in STAND_INS if c.isdigit()) | {"@", "$"}
_LETTERS = str.maketrans(STAND_INS)
_GAP = re.compile(r"[\W\d_]+")


def _read(run: re.Match) -> str:
    """The letters of a run of digits and signs between letters or at the beginning of a word, else the run."""
    before = run.string[run.start() - 1] if run.start() else " "
    begins = not (before.isalnum() or before == "_") and _BEGINS.issuperset(run.group())
    return run.group().translate(_LETTERS) if begins or _LETTER.match(before) else run.group()


def fold(text: str | None) -> str:
    """The folded words of a text with a single space around each."""
    low = (text or "").lower()
    if not low.isascii():
        low = _MARKS.sub("", unicodedata.normalize("NFKC", low)).lower()
        low = low.translate(_TABLE) if _LOOKS.search(low) else low
    return f" {_GAP.sub(' ', _RUN.sub(_read, low)).strip()} "


@lru_cache(1 << 16)
def bare(word: str) -> str:
    """A folded word without accents, itself if that leaves no letter or more than one word."""
    if word.isascii():
        return word
    plain = _GAP.sub("", _MARKS.sub("", unicodedata.normalize("NFKD", word)).translate(_TABLE))
    return plain or word


def _entries(word: str) -> set[str]:
    """Patterns that match a word: beginnings of it and the whole, as it is and without accents."""
    return {f" {w[:n]}" for w in {word, bare(word)} for n in PREFIXES if n <= len(w)} | {f" {w} " for w in {word, bare(word)}}


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    #: intercept and the weights of the two length-normalised sums
    fit: tuple[float, float, float] = (0.0, 0.0, 0.0)
    tree: object = None
    bare_matches: dict[str, bool] = field(default_factory=dict)

    def built(self):
        if self.tree is None and self.weights:
            self.tree = ahocorasick.Automaton()
            for entry, weight in self.weights.items():
                self.tree.add_word(entry, ("hit", len(entry), weight))
            for phrase in self.exceptions:
                self.tree.add_word(f" {phrase} ", ("exception", len(phrase) + 2, 0.0))
            self.tree.make_automaton()
        return self.tree

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "fit": self.fit}

    def __setstate__(self, state):
        self.__dict__.update(state, tree=None, bare_matches={})

    def _scan(self, folded: str) -> tuple[dict[int, float], set[int]]:
        """Weights of matched words and the words of exception phrases, by where the space before a word stands."""
        found: dict[int, float] = {}
        spared: set[int] = set()
        for end, (kind, length, weight) in self.tree.iter(folded):
            start = end - length + 1
            if kind == "hit":
                found[start] = max(weight, found.get(start, 0.0))
            else:
                spared |= {i for i in range(start, end) if folded[i] == " "}
        return found, spared

    def _matches_bare(self, word: str) -> bool:
        """Whether an entry matches a word without its accents; kept, since texts repeat their words."""
        if word not in self.bare_matches:
            if len(self.bare_matches) > 1 << 18:
                self.bare_matches.clear()
            plain = bare(word)
            self.bare_matches[word] = plain != word and any(e in self.weights for e in _entries(plain))
        return self.bare_matches[word]

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each matched word (the space before it) and its weight, without exception phrases."""
        if self.built() is None:
            return {}
        found, spared = self._scan(folded)
        if not folded.isascii():
            words = folded.split()
            # without a match in either reading there is nothing to spare, and no need to scan the other one
            plain = [bare(w) for w in words] if found or any(self._matches_bare(w) for w in set(words) if not w.isascii()) else words
            if plain != words:
                own, other = ([0, *accumulate(len(w) + 1 for w in ws)] for ws in (words, plain))
                place = dict(zip(other, own))
                more, further = self._scan(f" {' '.join(plain)} ")
                for at, weight in more.items():
                    found[place[at]] = max(weight, found.get(place[at], 0.0))
                spared |= {place[at] for at in further}
        return {at: weight for at, weight in found.items() if at not in spared}

    def measures(self, text: str | None) -> tuple[float, float]:
        """Sum of weights by the square root of the number of words, and its logarithm by length."""
        folded = fold(text)
        total = sum(self.hits(folded).values())
        words = max(folded.count(" ") - 1, 1)
        return total / words**0.5, np.log1p(100.0 * total / words)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.measures(t) for t in texts]).reshape(-1, 2)
        z = self.fit[0] + x @ np.array(self.fit[1:])
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-z))


def _count_entries(only: set[str] | None):
    """Per partition: (entry, occurrences, texts) over its texts; the entry '' counts words. ``only`` restricts entries."""

    def count(batches):
        hits, texts, words = Counter(), Counter(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                each = Counter(fold(text).split())
                words += each.total()
                own: Counter = Counter()
                for word, n in each.items():
                    for entry in _entries(word):
                        if only is None or entry in only:
                            own[entry] += n
                hits.update(own)
                texts.update(own.keys())
        keys = list(hits)
        yield pa.RecordBatch.from_arrays([pa.array([*keys, ""]), pa.array([*(hits[k] for k in keys), words], pa.int64()), pa.array([*(texts[k] for k in keys), 0], pa.int64())], ["entry", "hits", "texts"])

    return count


_COUNTED = "entry string, hits long, texts long"


def learn_entries(toxic: DataFrame, clean: DataFrame) -> dict[str, float]:
    """The weighted entries that tell the two samples of texts apart; their number is bounded by the samples' words."""
    total = lambda df, only=None: df.select("text").mapInArrow(trimmed(_count_entries(only)), _COUNTED).groupBy("entry").agg(F.sum("hits").alias("hits"), F.sum("texts").alias("texts"))
    often = {r["entry"]: (r["hits"], r["texts"]) for r in total(toxic).where(f"texts >= {MIN_TEXTS} or entry = ''").collect()}
    toxic_words = max(often.pop("", (0, 0))[0], 1)
    other = {r["entry"]: r["hits"] for r in total(clean, set(often)).collect()}
    clean_words = max(other.pop("", 0), 1)
    kept: dict[str, float] = {}
    for entry, (n, _) in sorted(often.items()):
        expected = (other.get(entry, 0) + 0.5) * toxic_words / clean_words
        weight, deviations = np.log((n + 0.5) / expected), (n - expected) / np.sqrt(expected + 1.0)
        if weight >= MIN_WEIGHT and deviations >= MIN_DEVIATIONS:
            kept[entry] = round(float(weight), 6)
    return kept


def _context(lexicon: Lexicon):
    """Of each text: its label, measures, and the two-word phrases around its matches."""

    def context(batches):
        for batch in batches:
            labels, first, second, phrases = [], [], [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                near = set()
                for at in lexicon.hits(folded):
                    stop = folded.index(" ", at + 1)
                    after = folded[stop + 1 : folded.find(" ", stop + 1)] if stop + 1 < len(folded) else ""
                    before = folded[folded.rfind(" ", 0, at) + 1 : at] if at else ""
                    word = folded[at + 1 : stop]
                    near |= {f"{word} {after}"} if after else set()
                    near |= {f"{before} {word}"} if before else set()
                a, b = lexicon.measures(text)
                labels.append(label)
                first.append(a)
                second.append(b)
                phrases.append(sorted(near))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(first, pa.float64()), pa.array(second, pa.float64()), pa.array(phrases, pa.list_(pa.string()))], ["label", "a", "b", "phrases"])

    return context


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, ...]:
    """Intercept and weights by Newton steps, never negative weights: more matches never lower a score."""
    active = [True] * x.shape[1]
    while True:
        cols = [i for i, on in enumerate(active) if on]
        a = np.column_stack([np.ones(len(x)), x[:, cols]])
        w = np.zeros(a.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)) * max(len(x), 1) ** 0.5
            step = np.linalg.solve(h, a.T @ (y - p) - ridge * max(len(x), 1) ** 0.5 * w)
            w += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break
        bad = [c for c, v in zip(cols, w[1:]) if v < 0]
        if not bad:
            full = np.zeros(x.shape[1])
            full[cols] = w[1:]
            return (float(w[0]), *map(float, full))
        for c in bad:
            active[c] = False


def train(docs: DataFrame, labels: DataFrame, exceptions: set[str] = frozenset(), label_col: str = "toxic") -> Lexicon:
    """A lexicon from labelled rows; the labels given are the training labels."""
    sample = labelled_sample(labels, label_col)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon({}, set(), (np.inf if sizes.get(1) else -np.inf, 0.0, 0.0))
    texts = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text"), "labelled")
    lexicon = Lexicon(learn_entries(texts.where("label = 1"), texts.where("label = 0")), set(exceptions))
    rows = texts.mapInArrow(trimmed(_context(lexicon)), "label int, a double, b double, phrases array<string>")
    seen = rows.collect()  # one short row for each row of the bounded sample
    counts = {0: Counter(), 1: Counter()}
    for r in seen:
        counts[r["label"]].update(set(r["phrases"]))
    share = sizes[1] / (sizes[0] + sizes[1])
    learned = {p for p, n in counts[0].items() if n >= MIN_PHRASE and counts[1][p] <= share * n}
    if learned:
        lexicon = Lexicon(lexicon.weights, set(exceptions) | learned)
        seen = texts.mapInArrow(trimmed(_context(lexicon)), "label int, a double, b double, phrases array<string>").collect()
    x = np.array([(r["a"], r["b"]) for r in seen], dtype=float).reshape(-1, 2)
    return Lexicon(lexicon.weights, lexicon.exceptions, _logistic(x, np.array([r["label"] for r in seen], dtype=float)))


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicon.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(score), f"doc_id {kind}, score double")


def split_number(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; rows of split 2 of 4 are never learned from."""
    lexicon = train(docs, labels.where(split_number("doc_id", 4) != 2))
    return score_documents(docs, lexicon).select("doc_id", (split_number("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
