"""Benchmark decontamination by an Aho-Corasick automaton over normalised test items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became lower case. A window is 10 consecutive item
words (an item of fewer words is one window). Ten words in a row hold one of the item's blocks of five words
at places 0, 5, 10, ..., so the automaton has these blocks, framed by single spaces, and takes about as much
as the items' text. Texts are normalised the same way and scanned once; a block that occurs is extended in
both directions as far as text and item agree, and ten words or more are a hit. Hits carry offsets in code
points of the original text.

Items lie in the shared folder in slices of bounded size. A task reads its texts once and takes one slice
after the other to the texts it holds, so memory is bounded by a slice and the held texts whatever the
benchmark's size, and neither items nor texts go through the driver.

Results for odd input: a null or wordless text has no words, no hits and is clean; a null or wordless item
makes no window; items that repeat an id count once; the windows of items without an id count too, as one
item that adds nothing to the list of ids; an empty benchmark flags nothing; an empty table gives an empty
result; other columns pass through ``decontaminate`` untouched and are ignored elsewhere.
"""

from __future__ import annotations

import atexit
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import _forget, bound_batches, table_path, trimmed
from ._shared_arrays import SharedArrays

WINDOW = 10
#: Bytes of item text that one automaton takes (about sixty times as much memory), and of texts held while slices change.
SLICE_BYTES, HELD_BYTES = 4 << 20, 32 << 20

_FLAT = bytearray(range(256))
for _b in range(128):
    _FLAT[_b] = _b + 32 if 0x41 <= _b <= 0x5A else _b if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A else 0x20
_FLAT = bytes(_FLAT)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FLAT).split()


class Scanner:
    """The automaton of one slice of (item, text) rows."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        block = (window + 1) // 2
        self.items, self.words = [], []
        places: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            if not (words := _words(text)):
                continue
            for at in range(0, len(words) - block + 1, block) if len(words) >= window else [0]:
                pattern = words[at : at + block] if len(words) >= window else words
                places.setdefault(_framed(pattern), []).append((len(self.words), at))
            self.items.append(item)
            self.words.append(words)
        self.tree = ahocorasick.Automaton()
        for pattern, where in places.items():
            self.tree.add_word(pattern, (len(pattern), where))
        self.empty = not places
        self.tree.make_automaton() if places else None

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str | None]]]:
        """(number of words, hits as (first word, end word, item)) of one text; a hit is as long as text and item agree."""
        words = _words(text)
        if self.empty or not words:
            return len(words), []
        flat = _framed(words)
        met = [(end - length + 1, where) for end, (length, where) in self.tree.iter(flat)]
        if not met:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32) == 0x20)
        hits: list[tuple[int, int, str | None]] = []
        upto: dict[tuple[int, int], int] = {}  # where the last run of an item ends that begins so many words before its text
        for first, (_, where) in zip(np.searchsorted(spaces, [f for f, _ in met]).tolist(), met):
            for item, at in where:
                own = self.words[item]
                if first < upto.get((item, first - at), 0):
                    continue
                a, b = first, first
                while a and a - first + at and words[a - 1] == own[a - 1 - first + at]:
                    a -= 1
                while b < len(words) and b - first + at < len(own) and words[b] == own[b - first + at]:
                    b += 1
                upto[item, first - at] = b
                if b - a >= min(self.window, len(own)):
                    hits.append((a, b, self.items[item]))
        return len(words), hits


def _framed(words: list[bytes]) -> str:
    return f" {b' '.join(words).decode('utf-8', 'replace')} "


def covered(spans: list[tuple[int, int]]) -> int:
    """Positions inside the union of half-open spans."""
    total, upto = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def original_spans(text: str, hits: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """(item, start, end) of hits in code points of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(item, at[a][0], at[b - 1][1]) for a, b, item in hits]


def _store_items(store: SharedArrays):
    """Write the items of a partition in slices of bounded size; return the slices' names."""

    def put(name: str, rows: list[tuple[str | None, bytes]]) -> pa.RecordBatch:
        ids = [(i or "").encode("utf-8", "replace") for i, _ in rows]
        named = np.array([i is not None for i, _ in rows])
        flat = lambda parts: np.frombuffer(b"".join(parts), np.uint8)
        store.write(name, ids=flat(ids), id_sizes=np.array(list(map(len, ids)), np.int64), named=named, texts=flat([t for _, t in rows]), text_sizes=np.array([len(t) for _, t in rows], np.int64))
        return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    def write(batches):
        part, rows, size = TaskContext.get().partitionId(), [], 0
        count = 0
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                rows.append((item, text.encode("utf-8", "replace")))
                size += len(rows[-1][1])
                if size >= SLICE_BYTES:
                    yield put(f"items-{part}-{count}", rows)
                    rows, size, count = [], 0, count + 1
        if rows:
            yield put(f"items-{part}-{count}", rows)

    return write


class _Items:
    """The benchmark's slices by name; a worker process holds the automaton of one at a time."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str):
        spark = benchmark.sparkSession
        bound_batches(spark)
        self.store = SharedArrays(table_path(spark, "items"))
        atexit.register(_forget, spark, self.store.uri)
        rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        slices = rows.coalesce(size // SLICE_BYTES + 1).mapInArrow(trimmed(_store_items(self.store)), "name string")
        self.names = sorted(r["name"] for r in slices.collect())

    def scanner(self, name: str) -> Scanner:
        if _scanners.get("name") != (self.store.uri, name):
            _scanners.clear()
            group = self.store.read(name)
            pieces = {}
            for part in ("id", "text"):
                raw, stops = group[f"{part}s"].tobytes(), np.cumsum(group[f"{part}_sizes"]).tolist()
                pieces[part] = [raw[a:b].decode("utf-8") for a, b in zip([0, *stops], stops)]
            ids = [i if named else None for i, named in zip(pieces["id"], group["named"].tolist())]
            _scanners.update(name=(self.store.uri, name), scanner=Scanner(list(zip(ids, pieces["text"]))))
        return _scanners["scanner"]

    def scanned(self, batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list]]]]:
        """Each batch with (number of words, hits) of every text, over all slices."""
        for held in _held(batches, HELD_BYTES if len(self.names) > 1 else 0):
            texts = [b.column(b.schema.get_field_index(column)).to_pylist() for b in held]
            found: list[list[tuple[int, list]]] = [[(0, [])] * len(t) for t in texts]
            for name in self.names or [None]:
                scanner = self.scanner(name) if name else Scanner([])
                for i, own in enumerate(texts):
                    found[i] = [(n, [*before, *hits]) for (_, before), (n, hits) in zip(found[i], map(scanner.scan, own))]
            yield from zip(held, found)


_scanners: dict = {}


def _held(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches together up to a number of bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits array<struct<item, first_word, end_word, start, end>>) for every row."""
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {key}, n_words long, hits array<struct<item:string,first_word:long,end_word:long,start:long,end:long>>"
    items = _Items(benchmark, item_col, item_text)
    kind = pa.list_(pa.struct([("item", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch, found in items.scanned(batches, "text"):
            hits = []
            for text, (_, own) in zip(batch.column(1).to_pylist(), found):
                placed = original_spans(text, own) if own else ()
                hits.append([{"item": i, "first_word": a, "end_word": b, "start": s, "end": e} for (a, b, i), (_, s, e) in zip(own, placed, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(hits, kind)], ["doc_id", "n_words", "hits"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(scan), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_hits(docs, benchmark, **names)
    spans = F.array_sort(F.transform("hits", lambda h: F.struct(h["first_word"].alias("a"), h["end_word"].alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    n_hit = F.aggregate(
        spans, start,
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["b"]).alias("upto")),
        lambda acc: acc["n"],
    )
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit, all columns as they were; one pass, no shuffle."""
    items = _Items(benchmark, item_col, item_text)

    def clean(batches):
        for batch, found in items.scanned(batches, text_col):
            yield batch.filter(pa.array([not hits for _, hits in found], pa.bool_()))

    return docs.mapInArrow(trimmed(clean), docs.schema)
