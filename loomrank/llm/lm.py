"""Interpolated modified Kneser-Ney n-gram model, counted in Spark and memory-mapped by the scoring workers.

Tokens are the lower-cased (A-Z) white-space words of a text and one end mark; the first token's context is
a start mark, which is never predicted. An n-gram's id is its place in sorted arrays: words are sorted by
their 64-bit hash; an n-gram hangs below its first n - 1 tokens, the context, and is named there by the rank
of its last n - 1 tokens below theirs. Ids of the shorter n-grams of a text thus lead to the longer ones.

Counting goes level by level over the training texts. Each task sends packed blocks of sorted (context,
rank, count) by unit, and a unit's blocks meet in one task, which writes its share of the sorted arrays to
the shared folder. A unit holds the contexts of one unit of the level before; a context that occurs more than
``HOT`` times is dealt over units of its own by the rank, so no frequent word or phrase is one task's work.
The distinct n-grams then send the places of their last n - 1 tokens, which gives the continuation counts
that the shorter levels use instead of counts (n-grams that begin with the start mark keep their counts).

    p(w | c) = (k(cw) - D(k(cw))) / k(c.) + g(c) p(w | shorter c),   p(w) = (k(w) - D(k(w))) / k(.) + g 1 / (V + 1)

D are the three discounts of each level, estimated from its counts of counts over all training data.
Ids, ranks and counts have 64 bits; arrays are stored in the narrowest type that holds them.

Results for odd input: a null text counts as empty and has the end mark alone; a null id counts as '' in
the split; without training rows every known share is the uniform one over one unknown word, so scores are
0; repeated rows are counted and scored each; an empty table gives an empty result; other columns are
ignored. Whole texts are scored.
"""

from __future__ import annotations

import atexit
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import _forget, table_path, trimmed, written
from ._shared_arrays import SharedArrays, least, narrow, widened
from ._text import string_slices, word_hashes

#: Words of a context and the word predicted from it, together.
ORDER = 3
#: Hash of the end mark; no word's bytes produce it but by chance of 2**-64.
END = np.uint64(int.from_bytes(hashlib.sha256(b"end of text").digest()[:8], "little"))
#: N-grams that a counting task gathers before it packs them, and UTF-8 bytes of text a unit is meant for.
GATHER, UNIT_BYTES = 2_000_000, 32 << 20
#: A context with more occurrences is dealt over units of its own, one for each so many.
HOT = 2_000_000
#: UTF-8 bytes of text that are scored at once.
SLICE = 4 << 20
#: UTF-8 bytes of text whose words are hashed at once.
HASHED = 1 << 20
#: Rows that search the range of one context from which on it is searched by itself.
MANY = 16
SMOOTHING = 0.1
_CLASSES = 4


# --- packed blocks ----------------------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of unsigned numbers of one length by byte planes, compressed; the first one rises and goes as differences."""
    head = np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0))
    narrowest = [least(c) for c in (head, *columns[1:])]
    widths = bytes(c.itemsize for c in narrowest)
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in narrowest]
    return widths + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    widths, raw = blob[:columns], np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[columns:]), np.uint8)
    n, out, at = len(raw) // sum(widths), [], 0
    for w in widths:
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(f"<u{w}").ravel().astype(np.uint64))
        at += n * w
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether pairs go into 64 bits, with room for -1 + 1 on both sides."""
    return bool(len(a)) and int(a.max()) < (1 << 32) - 1 and int(b.max()) < (1 << 32) - 1


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


def _sorted(*keys: np.ndarray) -> np.ndarray:
    """Order of rows by their keys, first key first."""
    if len(keys) == 2 and _fits(*keys):
        return np.argsort(_joined(*keys), kind="stable")
    return np.lexsort(keys[::-1])


def _summed(counts: np.ndarray | None, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and their summed counts (of single rows if there are none)."""
    n = len(keys[0])
    if not n:
        return (*keys, np.zeros(0, np.int64))
    if counts is None and (len(keys) == 1 or _fits(*keys)):
        flat = np.sort(keys[0] if len(keys) == 1 else _joined(*keys))
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        flat, total = flat[first], np.diff(np.append(first, n))
        return (flat, total) if len(keys) == 1 else ((flat >> np.uint64(32)).astype(np.int64), (flat & np.uint64(0xFFFFFFFF)).astype(np.int64), total)
    order = _sorted(*keys)
    keys = tuple(k[order] for k in keys)
    fresh = np.ones(n, bool)
    fresh[1:] = False
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(fresh)
    total = np.diff(np.append(first, n)) if counts is None else np.add.reduceat(counts[order].astype(np.int64), first)
    return (*(k[first] for k in keys), total)


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct value, values rising; which of them each row has)."""
    order = values.argsort()
    run = values[order]
    first = np.ones(len(run), bool)
    np.not_equal(run[1:], run[:-1], out=first[1:])
    back = np.empty(len(run), np.int32 if len(run) < 1 << 31 else np.int64)
    back[order] = np.cumsum(first, dtype=back.dtype) - 1
    return order[first], back


def _blocks(unit: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One packed block for each unit of rows whose units rise."""
    cuts = np.flatnonzero(np.diff(unit, prepend=-1, append=-1)) if len(unit) else np.zeros(1, np.int64)
    blobs = [_pack(*(c[a:b] for c in columns)) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(unit[cuts[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], ["unit", "blob"])


def _merged(table: pa.Table, columns: int) -> tuple[np.ndarray, ...]:
    """Distinct keys of a unit's blocks and their summed counts (the last column)."""
    parts = [_unpack(b.as_py(), columns) for b in table.column("blob")]
    *keys, counts = (np.concatenate([p[i] for p in parts]) for i in range(columns))
    return _summed(counts, *keys)


# --- tokens and words -------------------------------------------------------------------------------------


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, text numbers, place in the text) of a slice of texts, end marks included."""
    count, parts, at = len(offsets) - 1, [], 0
    while at < count:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + HASHED, side="right")) - 1)
        words, text = word_hashes(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        parts.append((words, text + at))
        at = end
    words, text = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out = np.full(len(words) + count, END, dtype=np.uint64)
    out[np.arange(len(words)) + text] = words
    sizes = np.bincount(text, minlength=count) + 1
    owner = np.repeat(np.arange(count), sizes)
    place = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return out, owner, place


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _count_words(bits: int):
    def packed(parts):
        keys, counts = _summed(None, np.concatenate(parts))
        return _blocks(_top(keys, bits), keys, counts)

    def count(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in string_slices(batch.column(0)):
                parts.append(tokens(data, offsets)[0])
                size += len(parts[-1])
                if size >= GATHER:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)

    return count


def _store_words(store: SharedArrays):
    def write(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        keys, counts = _merged(table, 2)
        store.write(f"words-{unit}", hash=keys, **narrow("count", counts))
        often = np.flatnonzero(counts > HOT)
        hot = pa.array([[{"at": a, "n": n} for a, n in zip(often.tolist(), counts[often].tolist())]], _HOT)
        return pa.table([pa.array([unit], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), hot], names=["unit", "entries", "tokens", "hot"])

    return write


_HOT = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
_HOT_DDL = "array<struct<at:long,n:long>>"


def _runs(unit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(unit, its rows) of rows in any order."""
    order = np.argsort(unit, kind="stable")
    edge = np.flatnonzero(np.diff(unit[order], prepend=-1, append=-1)) if len(unit) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1], edge[1:]):
        yield int(unit[order[a]]), order[a:b]


@dataclass
class Words:
    """The vocabulary: sorted word hashes in units by their first bits. A word's id and rank are its number."""

    store: SharedArrays
    bits: int
    offsets: np.ndarray  # first word number of each unit, and the number of words

    @property
    def start(self) -> int:
        """The number of the start mark, a context of the last unit."""
        return int(self.offsets[-1])

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of the distinct hashes, -1 for words that training never saw; which of them each hash has)."""
        own, back = _unique(hashes)
        distinct = hashes[own]
        out = np.full(len(distinct), -1, dtype=np.int64)
        unit = _top(distinct, self.bits)
        cuts = np.flatnonzero(np.diff(unit, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            u = int(unit[a])
            if self.offsets[u + 1] > self.offsets[u]:
                have = self.store.read(f"words-{u}")["hash"]
                at = np.searchsorted(have, distinct[a:b])
                at[at == len(have)] = 0
                out[a:b] = np.where(have[at] == distinct[a:b], at + self.offsets[u], -1)
        return out, back

    def gather(self, numbers: np.ndarray, *names: tuple[str, str]) -> list[np.ndarray]:
        """Values of narrow arrays (group, name) kept beside the words; 0 for unknown words."""
        out = [np.zeros(len(numbers), np.int64) for _ in names]
        unit = np.where(numbers >= 0, np.searchsorted(self.offsets, numbers, side="right") - 1, -1)
        for u, at in _runs(unit):
            if u >= 0:
                for values, (group, name) in zip(out, names):
                    values[at] = widened(self.store.read(f"{group}-{u}"), name, numbers[at] - self.offsets[u])
        return out


# --- longer n-grams ---------------------------------------------------------------------------------------


@dataclass
class Level:
    """The n-grams of one length: sorted below their contexts, in units.

    Unit u holds the contexts ``bounds[u]`` to ``bounds[u + 1]``, which are ids of the level before; the units
    behind those hold one part each of a hot context. A unit's file has, for each context, where its entries
    begin, and for each entry the rank of its last tokens and its count.
    """

    store: SharedArrays
    n: int
    bounds: np.ndarray
    hot: np.ndarray  # contexts dealt over units of their own, rising
    hot_unit: np.ndarray  # the first of these units
    hot_parts: np.ndarray
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first id of each unit, and the number of all
    hot_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))  # per hot context: entries, sum, of count 1, of 2

    @property
    def units(self) -> int:
        return len(self.bounds) - 1 + int(self.hot_parts.sum())

    def home(self, context: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit, which hot context or -1) of n-grams."""
        unit = np.searchsorted(self.bounds, context, side="right") - 1
        hot = np.full(len(unit), -1)
        if len(self.hot):
            at = np.searchsorted(self.hot, context)
            at[at == len(self.hot)] = 0
            which = np.flatnonzero(self.hot[at] == context)
            hot[which] = at[which]
            unit[which] = self.hot_unit[at[which]] + np.maximum(rank[which], 0) % self.hot_parts[at[which]]
        return unit, hot

    def base(self, unit: int) -> int:
        """The first context of a unit."""
        plain = len(self.bounds) - 1
        return int(self.bounds[unit] if unit < plain else self.hot[np.searchsorted(self.hot_unit, unit, side="right") - 1])

    def find(self, context: np.ndarray, rank: np.ndarray, stats: str | None = None) -> dict[str, np.ndarray]:
        """Ids and ranks of n-grams (-1 where there is none), with the names of ``stats`` also counts of n-gram and context.

        A context of -1 is unknown; a rank of -1 only asks for the context's figures.
        """
        names = ("count", "sum", "ones", "twos", "kinds") if stats else ()
        out = {"id": np.full(len(context), -1), "rank": np.full(len(context), -1)} | {k: np.zeros(len(context), np.int64) for k in names}
        known = np.flatnonzero(context >= 0)
        unit, hot = self.home(context[known], rank[known])
        for u, at in _runs(unit):
            rows = known[at]
            span = slice(int(rows[0]), int(rows[-1]) + 1) if rows[-1] - rows[0] + 1 == len(rows) else rows  # a unit's rows rise
            group = self.store.read(f"gram{self.n}-{u}")
            begin, ranks = group["begin"], group["rank"]
            own = context[span] - self.base(u)
            low, high = begin[own].astype(np.int64), begin[own + 1].astype(np.int64)
            place = _within(ranks, low, high, rank[span])
            got = np.flatnonzero(place >= 0)
            out["id"][rows[got]] = place[got] + self.offsets[u]
            out["rank"][rows[got]] = place[got] - low[got]
            if stats:
                side = self.store.read(f"{stats}{self.n}-{u}")
                out["count"][rows[got]] = widened(group if stats == "gram" else side, "count", place[got])
                for name in ("sum", "ones", "twos"):
                    out[name][span] = widened(side, name, own)
                out["kinds"][span] = high - low
            split = np.flatnonzero(hot[at] >= 0)
            if len(split):  # ranks go on from part to part, and figures are those of all parts
                h = hot[at[split]]
                part = rows[split]
                some = out["id"][part] >= 0
                out["rank"][part[some]] = out["id"][part[some]] - self.offsets[self.hot_unit[h[some]]]
                if stats:
                    for i, name in enumerate(("kinds", "sum", "ones", "twos")):
                        out[name][part] = self.hot_stats[h, i]
        return out

    def parents(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context, rank) of n-grams by id."""
        context, rank = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for u, at in _runs(np.searchsorted(self.offsets, ids, side="right") - 1):
            group = self.store.read(f"gram{self.n}-{u}")
            place = ids[at] - self.offsets[u]
            context[at] = self.base(u) + np.searchsorted(group["begin"], place, side="right") - 1
            rank[at] = group["rank"][place]
        return context, rank

    def first(self, context: np.ndarray) -> np.ndarray:
        """The id from which the ranks below a context count."""
        out = np.zeros(len(context), np.int64)
        unit, hot = self.home(context, np.zeros(len(context), np.int64))
        for u, at in _runs(unit):
            out[at] = self.store.read(f"gram{self.n}-{u}")["begin"][context[at] - self.base(u)].astype(np.int64) + self.offsets[u]
        split = hot >= 0
        out[split] = self.offsets[self.hot_unit[hot[split]]]
        return out


def _within(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value between low and high, where the values rise; -1 where it isn't there."""
    out = np.full(len(low), -1)
    open_ = np.flatnonzero((low < high) & (wanted <= np.iinfo(values.dtype).max) & (wanted >= 0))
    if not len(open_):
        return out
    narrow_ = np.int32 if len(values) < 1 << 31 else np.int64
    a, b, w = low[open_].astype(narrow_), high[open_].astype(narrow_), wanted[open_].astype(values.dtype)
    # ranges that many rows search one after the other are searched by themselves
    edge = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1], [True]]))
    many = np.flatnonzero(np.diff(edge) >= MANY)
    wide = np.zeros(len(a), bool)
    for x, y in zip(edge[many].tolist(), edge[many + 1].tolist()):
        begin, end = int(a[x]), int(b[x])
        own = values[begin:end]
        at = np.searchsorted(own, w[x:y])
        hit = np.flatnonzero(own[np.minimum(at, end - begin - 1)] == w[x:y])
        out[open_[x:y][hit]] = at[hit] + begin
        wide[x:y] = True
    rest = np.flatnonzero(~wide)
    open_, a, b, w = open_[rest], a[rest], b[rest], w[rest]
    while len(open_):
        middle = (a + b) >> 1
        have = values[middle]
        less = have < w
        hit = have == w
        out[open_[hit]] = middle[hit]
        a = np.where(less, middle + 1, a)
        b = np.where(less, b, middle)
        go = np.flatnonzero((a < b) & ~hit)
        open_, a, b, w = open_[go], a[go], b[go], w[go]
    return out


@dataclass
class Grams:
    """Words and the longer levels that are counted so far."""

    words: Words
    levels: list[Level]

    def chain(self, hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(contexts, ranks) of the n-grams one token longer than the longest counted, that end at each token."""
        number, back = self.words.numbers(hashes)
        ids = ranks = number[back]
        for length in range(2, len(self.levels) + 3):
            before = np.concatenate([[-1], ids[:-1]]) if len(ids) else ids
            if length == 2:
                before = np.where(place == 0, self.words.start, before)
            else:
                before = np.where(place < length - 2, -1, before)
            if length == len(self.levels) + 2:
                return before, ranks
            ids, ranks = self._found(self.levels[length - 2], before, ranks)
        raise AssertionError

    @staticmethod
    def _found(level: Level, context: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, back = _distinct(context, rank)
        found = level.find(context[own], rank[own])
        return found["id"][back], found["rank"][back]

    def suffix(self, n: int, ids: np.ndarray) -> np.ndarray:
        """Ids, at the level before, of the last n - 1 tokens of n-grams."""
        if n == 1:
            return np.zeros(len(ids), np.int64)
        context, rank = self.levels[n - 2].parents(ids)
        return rank if n == 2 else self.levels[n - 3].first(self.suffix(n - 1, context)) + rank


def _distinct(context: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of each distinct pair and the way back to all rows."""
    if _fits(context, rank):
        return _unique(_joined(context + 1, rank + 1))
    every = np.arange(len(context))
    return every, every


def _count_grams(grams: Grams, level: Level):
    def packed(parts):
        context, rank = (np.concatenate(c) for c in zip(*parts))
        context, rank, counts = _summed(None, context, rank)
        unit, _ = level.home(context, rank)
        if len(level.hot):
            order = np.argsort(unit, kind="stable")
            context, rank, counts, unit = context[order], rank[order], counts[order], unit[order]
        return _blocks(unit, context, rank, counts)

    def count(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in string_slices(batch.column(0), SLICE):
                hashes, _, place = tokens(data, offsets)
                context, rank = grams.chain(hashes, place)
                there = context >= 0
                parts.append((context[there], rank[there]))
                size += len(parts[-1][0])
                if size >= GATHER:
                    yield packed(parts)
                    parts, size = [], 0
        if size:
            yield packed(parts)

    return count


def _figures(own: np.ndarray, counts: np.ndarray, size: int) -> dict[str, np.ndarray]:
    """Per context: the sum of its entries' counts, and how many are 1 and 2."""
    out = narrow("sum", np.bincount(own, weights=counts, minlength=size).astype(np.int64))
    return out | narrow("ones", np.bincount(own[counts == 1], minlength=size)) | narrow("twos", np.bincount(own[counts == 2], minlength=size))


def _tally(unit: int, counts: np.ndarray) -> list[int]:
    """Unit, entries, sum of counts, and how many of them are 1 to 4."""
    return [unit, len(counts), int(counts.sum()), *(int((counts == i).sum()) for i in range(1, _CLASSES + 1))]


def _store_grams(grams: Grams, level: Level, top: bool):
    """Write a unit's arrays; return its figures, its frequent entries, and the places of its entries' last tokens."""
    lower = grams.levels[-1] if grams.levels else None
    edges = lower.offsets if lower is not None else grams.words.offsets

    def write(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        context, rank, counts = _merged(table, 3)
        context, rank = context.astype(np.int64), rank.astype(np.int64)
        size = int(level.bounds[unit + 1] - level.bounds[unit]) if unit < len(level.bounds) - 1 else 1
        own = context - level.base(unit)
        begin = np.zeros(size + 1, np.int64)
        np.cumsum(np.bincount(own, minlength=size), out=begin[1:])
        level.store.write(f"gram{level.n}-{unit}", begin=least(begin), rank=least(rank), **narrow("count", counts), **(_figures(own, counts, size) if top else {}))
        often = np.flatnonzero(counts > HOT)
        hot = [{"at": a, "n": n} for a, n in zip(often.tolist(), counts[often].tolist())]
        if lower is None:
            last = rank
        else:
            names, back = np.unique(context, return_inverse=True)
            last = lower.first(grams.suffix(level.n - 1, names))[back] + rank
        last, kinds = _summed(None, last)
        home = np.searchsorted(edges, last, side="right") - 1
        blocks = _blocks(home, last - edges[home], kinds)
        return pa.table(
            [pa.array([*blocks.column(0).to_pylist(), None], pa.int64()), pa.array([*blocks.column(1).to_pylist(), None], pa.binary()), pa.array([*[None] * blocks.num_rows, _tally(unit, counts)], pa.list_(pa.int64())), pa.array([*[None] * blocks.num_rows, hot], _HOT)],
            names=["unit", "blob", "tally", "hot"],
        )

    return write


def _store_words_kinds(grams: Grams):
    """Continuation counts of words: how many words they follow."""
    words = grams.words

    def write(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        at, kinds = _merged(table, 2)
        counts = np.zeros(int(words.offsets[unit + 1] - words.offsets[unit]), np.int64)
        counts[at.astype(np.int64)] = kinds
        words.store.write(f"kinds-{unit}", **narrow("count", counts))
        return pa.table([pa.array([_tally(unit, counts[counts > 0])], pa.list_(pa.int64()))], names=["tally"])

    return write


def _store_kinds(grams: Grams, level: Level):
    """Continuation counts of a level's n-grams; those that begin with the start mark keep their counts."""

    def write(table: pa.Table) -> pa.Table:
        unit = table.column("unit")[0].as_py()
        group = level.store.read(f"gram{level.n}-{unit}")
        n = len(group["rank"])
        begin = group["begin"].astype(np.int64)
        own = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        counts = np.zeros(n, np.int64)
        blobs = table.filter(pc.is_valid(table.column("blob")))
        if blobs.num_rows:
            at, kinds = _merged(blobs, 2)
            counts[at.astype(np.int64)] = kinds
        begun = np.flatnonzero(_begins(grams, level.n, own + level.base(unit)))
        counts[begun] = widened(group, "count", begun)
        level.store.write(f"kind{level.n}-{unit}", **narrow("count", counts), **_figures(own, counts, len(begin) - 1))
        return pa.table([pa.array([_tally(unit, counts)], pa.list_(pa.int64()))], names=["tally"])

    return write


def _begins(grams: Grams, n: int, context: np.ndarray) -> np.ndarray:
    """Whether n-grams with these contexts begin with the start mark."""
    for length in range(n, 2, -1):
        distinct, back = np.unique(context, return_inverse=True)
        context = grams.levels[length - 3].parents(distinct)[0][back]
    return context == grams.words.start


# --- the model --------------------------------------------------------------------------------------------


def discounts(t: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    if not t[0] or not t[1]:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = t[0] / (t[0] + 2 * t[1])
    out = [0.0] + [i - (i + 1) * y * t[i] / t[i - 1] if t[i - 1] else 0.5 * i for i in (1, 2, 3)]
    return np.clip(out, 0.0, [0, 1, 2, 3])


@dataclass
class Model:
    """All that a worker needs besides the arrays: a few numbers a unit."""

    grams: Grams
    train_tokens: int
    word_discounts: np.ndarray
    kinds: int  # distinct pairs of words
    spread: float  # weight of the uniform share
    discounts: list[np.ndarray]  # of each longer level

    @property
    def size(self) -> int:
        return self.grams.words.start

    def probabilities(self, hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(p(token | context), training count of the token) of a run of tokens."""
        words = self.grams.words
        distinct, back = words.numbers(hashes)
        names = [("words", "count"), ("kinds", "count")] if self.kinds else [("words", "count")]
        got = words.gather(distinct, *names)
        c = got[0][back]
        p = np.full(len(distinct), 1.0 / (self.size + 1))
        if self.kinds:
            k = got[1].astype(float)
            p = np.maximum(k - self.word_discounts[np.minimum(k, 3).astype(int)], 0) / self.kinds + self.spread * p
        p = p[back]
        ids = ranks = distinct[back]
        for i, level in enumerate(self.grams.levels):
            before = np.concatenate([[-1], ids[:-1]]) if len(ids) else ids
            before = np.where(place == 0, words.start, before) if i == 0 else np.where(place < i, -1, before)
            own, back = _distinct(before, ranks)
            f = level.find(before[own], ranks[own], "gram" if i == len(self.grams.levels) - 1 else "kind")
            d = self.discounts[i]
            front = np.maximum(f["count"] - d[np.minimum(f["count"], 3)], 0)
            rest = d[1] * f["ones"] + d[2] * f["twos"] + d[3] * (f["kinds"] - f["ones"] - f["twos"])
            total = np.maximum(f["sum"], 1)
            p = (front / total)[back] + np.where(f["sum"] > 0, rest / total, 1.0)[back] * p
            ids, ranks = f["id"][back], f["rank"][back]
        return p, c

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """(n_tokens, n_known, base_score, score) of each text."""
        n, known = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        base, score = np.zeros(len(column)), np.zeros(len(column))
        for a, b, data, offsets in string_slices(column, SLICE):
            hashes, owner, place = tokens(data, offsets)
            p, c = self.probabilities(hashes, place)
            share = np.log10((c + SMOOTHING) / (self.train_tokens + SMOOTHING * (self.size + 1)))
            n[a:b] = np.bincount(owner, minlength=b - a)
            known[a:b] = np.bincount(owner[c > 0], minlength=b - a)
            base[a:b] = np.bincount(owner, weights=share, minlength=b - a)
            score[a:b] = np.bincount(owner, weights=np.log10(p), minlength=b - a)
        return n, known, base, score


def _hot_units(first: int, contexts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, first unit, parts) of the contexts with too many occurrences, from (context, count) rows."""
    rows = sorted(contexts)
    parts = np.array([-(-n // HOT) for _, n in rows], np.int64)
    return np.array([c for c, _ in rows], np.int64), first + np.cumsum(parts) - parts, parts


def _sizes(rows, units: int) -> np.ndarray:
    out = np.zeros(units, np.int64)
    for unit, entries in rows:
        out[unit] = entries
    return np.concatenate([[0], np.cumsum(out)])


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """Count ``texts`` and write the model's arrays to the shared folder. ``order`` is 2 at least.

    The driver holds a few numbers for each unit and hot context, whose number follows the size of the texts
    divided by ``UNIT_BYTES`` and ``HOT``.
    """
    if order < 2:
        raise ValueError("a model has order 2 at least")
    spark = texts.sparkSession
    texts = texts.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = int(np.ceil(np.log2(max(64, size // UNIT_BYTES))))
    store = SharedArrays(table_path(spark, "model"))
    atexit.register(_forget, spark, store.uri)
    info = texts.mapInArrow(trimmed(_count_words(bits)), "unit long, blob binary").groupBy("unit").applyInArrow(_store_words(store), f"unit long, entries long, tokens long, hot {_HOT_DDL}").collect()
    words = Words(store, bits, _sizes(((r["unit"], r["entries"]) for r in info), 1 << bits))
    grams = Grams(words, [])
    hot = [(h["at"] + int(words.offsets[r["unit"]]), h["n"]) for r in info for h in r["hot"]]
    if (rows := texts.count()) > HOT:
        hot.append((words.start, rows))
    bounds = words.offsets.copy()
    bounds[-1] += 1  # the start mark
    found: list[np.ndarray] = []
    word_tally = np.zeros(6, np.int64)
    for n in range(2, order + 1):
        level = Level(store, n, bounds, *_hot_units(len(bounds) - 1, hot))
        counted = texts.mapInArrow(trimmed(_count_grams(grams, level)), "unit long, blob binary").groupBy("unit").applyInArrow(_store_grams(grams, level, n == order), f"unit long, blob binary, tally array<long>, hot {_HOT_DDL}")
        counted = written(counted, "grams")
        told = counted.where("tally is not null").select("tally", "hot").collect()
        level.offsets = _sizes((r["tally"][:2] for r in told), level.units)
        for u in range(level.units):
            if level.offsets[u] == level.offsets[u + 1]:  # a unit without n-grams still has its contexts
                contexts = int(level.bounds[u + 1] - level.bounds[u]) if u < len(level.bounds) - 1 else 1
                none = np.zeros(0, np.int64)
                store.write(f"gram{n}-{u}", begin=np.zeros(contexts + 1, np.uint8), rank=least(none), **narrow("count", none), **(_figures(none, none, contexts) if n == order else {}))
        blocks = counted.where("blob is not null").select("unit", "blob")
        if n == 2:
            kinds = blocks.groupBy("unit").applyInArrow(_store_words_kinds(grams), "tally array<long>").collect()
            word_tally = np.array([r["tally"][1:] for r in kinds] or [[0] * 6]).sum(axis=0)
        else:
            lower = grams.levels[-1]
            every = spark.range(lower.units).select(F.col("id").alias("unit"), F.lit(None).cast("binary").alias("blob"))
            kinds = blocks.unionByName(every).groupBy("unit").applyInArrow(_store_kinds(grams, lower), "tally array<long>").collect()
            found.append(np.array([r["tally"][1:] for r in kinds]).sum(axis=0))
            _total_hot(lower, "kind")
        if n == order:
            found.append(np.array([r["tally"][1:] for r in told] or [[0] * 6]).sum(axis=0))
            _total_hot(level, "gram")
        grams.levels.append(level)
        hot = [(h["at"] + int(level.offsets[r["tally"][0]]), h["n"]) for r in told for h in r["hot"]]
        bounds = level.offsets
    d = discounts(word_tally[2:].tolist())
    big = word_tally[0] - word_tally[2] - word_tally[3]
    spread = float((d[1] * word_tally[2] + d[2] * word_tally[3] + d[3] * big) / word_tally[1]) if word_tally[1] else 1.0
    return Model(grams, sum(r["tokens"] for r in info), d, int(word_tally[1]), spread, [discounts(t[2:].tolist()) for t in found])


def _total_hot(level: Level, group: str) -> None:
    """Put the figures of a hot context's parts together."""
    rows = []
    for unit, parts in zip(level.hot_unit.tolist(), level.hot_parts.tolist()):
        own = [level.store.read(f"{group}{level.n}-{u}") for u in range(unit, unit + parts)]
        entries = int(level.offsets[unit + parts] - level.offsets[unit])
        rows.append([entries, *(sum(int(widened(g, name, np.zeros(1, np.int64))[0]) for g in own) for name in ("sum", "ones", "twos"))])
    level.hot_stats = np.array(rows, np.int64).reshape(-1, 4)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, model.score(batch.column(1)))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(score), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, parts: int = 10, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); one of ``parts`` parts is held out."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == 0
    model = train(docs.where(~held_out), order=order)
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
