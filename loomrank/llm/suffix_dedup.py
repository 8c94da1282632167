"""Exact removal of repeated byte strings by suffix arrays of shards, built by external induced sorting.

A byte goes when some 200-byte string that covers it starts anywhere else too. The windows of 200 bytes are
dealt to shards by content: a window's anchor is the 128-byte string in it with the smallest hash, and equal
windows have equal anchors. Runs of windows with one anchor make a segment.

1. Every task sends its (anchor, segment) hashes with counts in packed blocks, dealt by both. Their buckets
   store the segments that occur more than once (all their windows are repeated); how many different ones an
   anchor has goes on to the anchor's bucket, which stores those with several, and the hot ones among these.
   An anchor that occurs once has no repeated window, so most text is settled here.
2. A hot anchor (the edge of a passage that many texts share) is dealt by more content: its segments are cut
   by where the anchor stands in the window, and the parts counted under all the bytes that their windows
   have in common, 191 of 200 and then all. So no shard grows with the number of texts around an anchor.
3. The bytes of the different segments of the other such anchors make the shards. A shard is read in batches
   and its suffixes are sorted by recursive induced sorting (``_suffix``): priority queues with a lane for each
   symbol carry suffixes with what they share with their neighbour. Bytes, text, types, names, order, queues and
   common prefixes lie in unnamed temporary files beyond a memory bound an array; neighbours that share 200
   bytes are repeated windows.
4. Each text's repeated windows, from all steps, are put together and cut out.

Hashes of 64 bits stand for segments.

Results for odd input: a null, empty or short text (under 200 bytes) loses nothing; a text that repeats
itself or another (also as a repeated row) loses every byte that such a string covers, in all its places;
matches never cross texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import _forget, bound_batches, table_path, trimmed
from ._shared_arrays import SharedArrays
from ._suffix import Spool, chunks, scratch, suffixes
from ._text import _P, _P_INV, mix, powers, string_slices

WINDOW, ANCHOR = 200, 128
#: Segments that a task gathers before it packs them.
GATHER = 400_000
#: UTF-8 bytes of text that a bucket of hashes is meant for, and those whose unsettled segments make one shard.
BUCKET_BYTES, SHARD_BYTES = 32 << 20, 8 << 20
#: UTF-8 bytes of text whose segments are looked up at once; a lookup goes through all buckets.
LOOKUP = 16 << 20
#: UTF-8 bytes of text for each task that sorts shards.
TASK_BYTES = 16 << 20
#: An anchor with more different segments is dealt by more content, ...
HOT = 2_048
#: ... with parts of so many places of the anchor in the window, level by level.
PARTS = (WINDOW - ANCHOR + 1, 10, 1)
#: Windows of one text that are hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 20
#: Bytes of text that a worker hashes at once; its working arrays take about a hundred times as many.
SLICE = 1 << 18
#: Repeated segments of a shard that are remembered, and segments of a shard whose results are sent on at once.
SEEN, SEGMENTS = 1 << 18, 50_000
_POSITION = np.uint64(0xFFFFFF)


def segments(data: np.ndarray, offsets: np.ndarray, hot=()) -> tuple[np.ndarray, ...]:
    """(first window, last window, key, segment hash, level, text hash, text number) of a slice of texts.

    The key is the anchor's hash, or at a higher level that of the bytes common to a part's windows; ``hot``
    has, for each level but the last, what tells which keys are dealt further.
    """
    parts = []
    for text in range(len(offsets) - 1) if len(data) > PIECE + WINDOW else [None]:
        bounds = offsets if text is None else offsets[text : text + 2]
        whole = None if text is None else _hash_of(data[bounds[0] : bounds[1]])
        for a in range(int(bounds[0]), max(int(bounds[-1]) - WINDOW + 1, int(bounds[0]) + 1), PIECE) if text is not None else [int(bounds[0])]:
            b = int(bounds[-1]) if text is None else min(int(bounds[1]), a + PIECE + WINDOW - 1)
            own = offsets if text is None else np.array([0, b - a])
            first, last, key, segment, level, texts, number = _segments(data[a:b], own, hot)
            parts.append((first + a, last + a, key, segment, level, texts if text is None else np.full(len(first), whole), number if text is None else np.full(len(first), text)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=total[1:])
    return total


def _hash_of(data: np.ndarray) -> np.uint64:
    return mix(_sums(data)[-1:] ^ np.uint64(len(data)))[0]


def _segments(data: np.ndarray, offsets: np.ndarray, hot) -> tuple[np.ndarray, ...]:
    none, big = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    empty = none, none, big, big, none, big, none
    n = len(data)
    if n < WINDOW:
        return empty
    total, back = _sums(data), powers(_P_INV, n + 1)
    span_hash = lambda a, b: (total[b] - total[a]) * back[a]
    grams = mix((total[ANCHOR:] - total[:-ANCHOR]) * back[: n - ANCHOR + 1])
    # the hash's upper bits, and the place turned round, so that of equal hashes the last one is least
    least = (grams & ~_POSITION) | (_POSITION - np.arange(len(grams), dtype=np.uint64))
    span, width = 1, WINDOW - ANCHOR + 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: -(width - span)], least[width - span :])
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + WINDOW <= room)
    if not len(at):
        return empty
    chosen = (_POSITION - (least[at] & _POSITION)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[begin], at[np.append(begin[1:], len(at)) - 1]
    chosen = chosen[begin]
    # the least hashes lie close together; mixed again they spread over all buckets
    key, low, level = mix(grams[chosen] ^ np.uint64(0x5851F42D4C957F2D)), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    for deeper, is_hot in enumerate(hot, 1):
        split = np.flatnonzero(level == deeper - 1)
        split = split[is_hot(key[split])]
        if not len(split):
            break
        size, upto = PARTS[deeper], low[split] + PARTS[deeper - 1] - 1
        one = (chosen[split] - last[split] - low[split]) // size  # parts by the place of the anchor in the window
        parts = (chosen[split] - first[split] - low[split]) // size - one + 1
        own = np.repeat(np.arange(len(split)), parts)
        part = np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts) + one[own]
        source = split[own]
        from_, to = low[source] + part * size, np.minimum(low[source] + (part + 1) * size - 1, upto[own])
        common = mix(span_hash(chosen[source] - from_, chosen[source] - to + WINDOW) ^ mix((from_ * 4 + deeper).astype(np.uint64)))
        stay = np.ones(len(first), bool)
        stay[split] = False
        put = lambda old, new: np.concatenate([old[stay], new])
        new_first, new_last = np.maximum(first[source], chosen[source] - to), np.minimum(last[source], chosen[source] - from_)
        first, last, key, low, level, chosen = put(first, new_first), put(last, new_last), put(key, common), put(low, from_), put(level, np.full(len(own), deeper)), put(chosen, chosen[source])
    order = np.argsort(first, kind="stable")
    first, last, key, level = first[order], last[order], key[order], level[order]
    segment = mix(span_hash(first, last + WINDOW) ^ mix((last - first).astype(np.uint64)))
    number = np.searchsorted(offsets, first, side="right") - 1
    whole = mix(span_hash(offsets[:-1], offsets[1:]) ^ np.diff(offsets).astype(np.uint64))
    return first, last, key, segment, level, whole[number], number


def _zip(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of one length by byte planes, compressed; the first is sorted and sent as differences."""
    head = np.diff(arrays[0].astype(np.uint64), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in (head, *arrays[1:])]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(planes))


def _unzip(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    widths = [np.dtype(d).itemsize for d in dtypes]
    n, out, at = len(raw) // sum(widths), [], 0
    for d, w in zip(dtypes, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * w].reshape(w, n).T).view(d).ravel())
        at += n * w
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(0, int)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist()))


@dataclass
class Settled:
    """What the levels counted so far tell of a key: stored by bucket in the shared folder."""

    store: SharedArrays
    bits: int
    levels: int = 0

    @property
    def hot(self) -> list:
        """For each counted level but the last possible one, which keys go to the next."""
        return [lambda keys, level=level: self.has("hot", level, keys) for level in range(min(self.levels, len(PARTS) - 1))]

    def has(self, name: str, level: int, values: np.ndarray) -> np.ndarray:
        """Whether each value is in the sorted array of its bucket."""
        out, kind = np.zeros(len(values), bool), "same" if name == "same" else "keys"
        order = values.argsort()
        values = values[order]
        home = _top(values, self.bits)
        for a, b in _cuts(home):
            group = self.store.get(f"{kind}-{level}-{home[a]}")
            have = group[name] if group else ()
            if len(have):
                at = np.searchsorted(have, values[a:b])
                at[at == len(have)] = 0
                out[order[a:b]] = have[at] == values[a:b]
        return out

    def by_level(self, name: str, level: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), bool)
        for n in range(self.levels):
            own = np.flatnonzero(level == n)
            out[own] = self.has(name, n, values[own])
        return out

    def mixed(self, level: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return self.by_level("mixed", level, keys)

    def same(self, level: np.ndarray, keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return self.by_level("same", level, _pair(keys, segment))


def _pair(keys: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """One hash of a key and a segment."""
    return mix(mix(keys) ^ segment)


def _blocks(bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    cuts = _cuts(bucket)
    return pa.RecordBatch.from_arrays([pa.array([int(bucket[a]) for a, _ in cuts], pa.int32()), pa.array([_zip(*(c[a:b] for c in columns)) for a, b in cuts], pa.binary())], ["bucket", "blob"])


def _distinct(values: np.ndarray, counts: np.ndarray | None, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values in order, their summed counts, and the other columns of one row each."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(values))) if counts is None else np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return (values[first], total, *(m[order][first] for m in more))


def _count(settled: Settled):
    """Blocks of (hash of key and segment, key, count) of the next level by bucket of that hash: no key is one bucket's work."""

    def pack(parts):
        key, segment = (np.concatenate(c) for c in zip(*parts))
        pair, counts, key = _distinct(_pair(key, segment), None, key)
        return _blocks(_top(pair, settled.bits), pair, key, counts.astype("<u4"))

    def count(batches):
        parts, size = [], 0
        for batch in batches:
            for _, _, data, offsets in string_slices(batch.column(0), SLICE):
                _, _, key, segment, level, _, _ = segments(data, offsets, settled.hot)
                own = level == settled.levels
                parts.append((key[own], segment[own]))
                size += len(parts[-1][0])
                if size >= GATHER:
                    yield pack(parts)
                    parts, size = [], 0
        if size:
            yield pack(parts)

    return count


def _settle_pairs(settled: Settled):
    """Store a bucket's repeated segments; pass on how many different segments it has of each key."""

    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        pair, key, count = (np.concatenate(c) for c in zip(*(_unzip(b, "<u8", "<u8", "<u4") for b in table.column("blob").to_pylist())))
        pair, count, key = _distinct(pair, count, key)
        settled.store.write(f"same-{settled.levels}-{bucket}", same=pair[count > 1])
        key, different = _distinct(key, None)
        return pa.Table.from_batches([_blocks(_top(key, settled.bits), key, different.astype("<u4"))])

    return settle


def _settle_keys(settled: Settled):
    """Store a bucket's keys with several different segments, hot ones apart; a key has one row a bucket of pairs at most."""

    def settle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        key, n = (np.concatenate(c) for c in zip(*(_unzip(b, "<u8", "<u4") for b in table.column("blob").to_pylist())))
        key, different = _distinct(key, n)
        hot = (different > HOT) & (settled.levels < len(PARTS) - 1)
        settled.store.write(f"keys-{settled.levels}-{bucket}", mixed=key[(different > 1) & ~hot], hot=key[hot])
        return pa.table([pa.array([int(hot.sum())], pa.int64())], names=["hot"])

    return settle


def _slices(batches, column: int, settled: Settled):
    """Lists of (batch, first row, end row, bytes, offsets, segments) of slices of texts, about ``LOOKUP`` bytes together."""
    held, size = [], 0
    for batch in batches:
        for a, b, data, offsets in string_slices(batch.column(column), SLICE):
            held.append((batch, a, b, data, offsets, segments(data, offsets, settled.hot)))
            size += len(data)
            if size >= LOOKUP:
                yield held
                held, size = [], 0
    if held:
        yield held


def _joined(slices: list, *columns: int) -> list[np.ndarray]:
    return [np.concatenate([s[5][c] for s in slices]) for c in columns]


def _each(slices: list, values: np.ndarray) -> list[np.ndarray]:
    """Values of all slices' segments by slice."""
    return np.split(values, np.cumsum([len(s[5][0]) for s in slices])[:-1])


def _gather(settled: Settled, bits: int):
    """Blocks of the bytes of unsettled segments by bucket: those that occur once, and one copy a task of others."""

    def pack(bucket, rows):
        key, start, seg, again, blobs = zip(*rows)
        head = _zip(np.zeros(len(rows), np.uint64), np.array(key, "<u8"), np.array(start, "<i8"), np.array(seg, "<u8"), np.array(again, np.uint8), np.array(list(map(len, blobs)), "<u4"))
        return bucket, head, zstandard.ZstdCompressor(level=3).compress(b"".join(blobs))

    def gather(batches):
        seen: set[int] = set()
        held: dict[int, list] = {}
        size = 0

        def flush():
            rows = [pack(b, r) for b, r in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "head", "bytes"])

        for slices in _slices(batches, 0, settled):
            level, key, segment = _joined(slices, 4, 2, 3)
            mixed = settled.mixed(level, key)
            same = np.zeros(len(mixed), bool)
            same[mixed] = settled.same(level[mixed], key[mixed], segment[mixed])
            for (_, _, _, data, offsets, (first, last, key, segment, _, whole, number)), open_, again in zip(slices, _each(slices, mixed), _each(slices, same)):
                home = _top(key, bits)
                open_ = np.flatnonzero(open_)
                for i, twice in zip(open_.tolist(), again[open_].tolist()):
                    if twice:
                        if (s := int(segment[i])) in seen:
                            continue
                        seen.add(s)
                    raw = data[first[i] : last[i] + WINDOW].tobytes()
                    held.setdefault(int(home[i]), []).append((whole[i], first[i] - offsets[number[i]], segment[i], twice, raw))
                    size += len(raw)
                if size >= 16 << 20:
                    yield flush()
                    held, size, seen = {}, 0, set()
        if held:
            yield flush()

    return gather


def _twice(joined: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where windows start that have an equal one elsewhere, in strings that each end with one more byte."""
    n = len(joined)
    text = scratch(n + 1, np.int16)
    for a, b in chunks(n):
        text[a:b] = joined[a:b]
        text[a:b] += 2
    for a, b in chunks(len(starts)):
        text[starts[a:b] + lengths[a:b]] = 1  # after each string; smaller than any byte
    text[n] = 0
    order, shared = suffixes(text)
    del text
    twice = scratch(n, bool, False)
    for a, b in chunks(n - 1):  # pairs of neighbours behind the end, which comes first
        at = order[a + 1 : b + 2].astype(np.int64)
        owner = np.searchsorted(starts, at, side="right") - 1
        whole = at + WINDOW <= starts[owner] + lengths[owner]
        near = np.flatnonzero(whole[1:] & whole[:-1] & (shared[a + 2 : b + 2] >= WINDOW))
        twice[at[near]] = True
        twice[at[near + 1]] = True
    return twice


def _begins(lengths: np.ndarray) -> np.ndarray:
    """Where strings of these lengths begin, one byte apart."""
    out = scratch(len(lengths), np.int64)
    upto = 0
    for a, b in chunks(len(lengths)):
        stops = np.cumsum(lengths[a:b] + 1) + upto
        out[a:b] = stops - lengths[a:b] - 1
        upto = int(stops[-1])
    return out


def repeated_windows(parts: list[bytes]) -> list[np.ndarray]:
    """For each byte string, which of its 200-byte windows start in more than one place of all of them."""
    if not len(parts):
        return []
    lengths = np.array(list(map(len, parts)), np.int64)
    starts = _begins(lengths)
    twice = _twice(np.frombuffer(b"\0".join(parts) + b"\0", np.uint8), starts, lengths)
    return [twice[s : s + max(n - WINDOW + 1, 0)] for s, n in zip(starts.tolist(), lengths.tolist())]


def _search(bits: int):
    """Suffix-sort one shard: (text bucket, text hash, from, to) of the repeated parts of segments that occur once.

    A shard is read batch by batch into spools; nothing of its length is held in memory beyond ``_suffix.MEMORY`` an array.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, lengths, keys, begins, repeated = Spool(np.uint8), Spool(np.int64), Spool(np.uint64), Spool(np.int64), Spool(bool)
        seen: set[int] = set()
        for batch in batches:
            for head, blob in zip(batch.column("head"), batch.column("bytes")):
                _, key, start, seg, again, n = _unzip(head.as_py(), "<u8", "<u8", "<i8", "<u8", "u1", "<u4")
                raw, n = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.uint8), n.astype(np.int64)
                fresh = np.ones(len(n), bool)
                for i in np.flatnonzero(again).tolist():
                    fresh[i] = (s := int(seg[i])) not in seen
                    seen.add(s)
                if len(seen) > SEEN:
                    seen = set()  # a copy more is sorted with the rest; it changes no result
                ends = np.cumsum(n[fresh] + 1)
                if not len(ends):
                    continue
                piece, inside = np.zeros(ends[-1], np.uint8), np.ones(ends[-1], bool)
                inside[ends - 1] = False
                piece[inside] = raw[np.repeat(fresh, n)]
                for spool, values in ((joined, piece), (lengths, n[fresh]), (keys, key[fresh]), (begins, start[fresh]), (repeated, again[fresh].astype(bool))):
                    spool.add(values)
        joined, lengths, keys, begins, repeated = (x.array() for x in (joined, lengths, keys, begins, repeated))
        starts = _begins(lengths)
        twice = _twice(joined, starts, lengths)
        for a in range(0, len(lengths), SEGMENTS):
            b = min(a + SEGMENTS, len(lengths))
            base = int(starts[a])
            some = twice[base : int(starts[b - 1] + lengths[b - 1])]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], some.view(np.int8), [0]])))
            at, size = edge[::2] + base, edge[1::2] - edge[::2]
            owner = a + np.searchsorted(starts[a:b], at, side="right") - 1  # a run ends before its string does
            once = ~repeated[owner]
            at, size, owner = at[once], size[once], owner[once]
            key, begin = keys[owner], begins[owner] + at - starts[owner]
            yield pa.RecordBatch.from_arrays([pa.array(_top(key, bits).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(begin), pa.array(begin + size - 1 + WINDOW)], names=["home", "key", "begin", "end"])

    return search


def _store_parts(store: SharedArrays):
    def write(table: pa.Table) -> pa.Table:
        bucket = table.column("home")[0].as_py()
        key = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key, kind="stable")
        store.write(f"parts-{bucket}", key=key[order], **{c: table.column(c).to_numpy()[order] for c in ("begin", "end")})
        return pa.table([pa.array([bucket], pa.int32())], names=["bucket"])

    return write


def covered(data: np.ndarray, offsets: np.ndarray, found: tuple[np.ndarray, ...], twice: np.ndarray, settled: Settled) -> np.ndarray:
    """Which bytes of a slice of texts go; ``found`` are its segments, ``twice`` tells those that occur more than once."""
    first, last, _, _, _, whole, number = found
    marks = np.zeros(len(data) + 1, np.int64)
    np.add.at(marks, first[twice], 1)
    np.add.at(marks, last[twice] + WINDOW, -1)
    some = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, bool)
    for name, home, text in zip(whole[some], _top(whole[some], settled.bits).tolist(), number[some]):
        have = settled.store.get(f"parts-{home}")
        if have:
            a, b = np.searchsorted(have["key"], name, "left"), np.searchsorted(have["key"], name, "right")
            if b > a:
                np.add.at(marks, have["begin"][a:b] + offsets[text], 1)
                np.add.at(marks, have["end"][a:b] + offsets[text], -1)
    return np.cumsum(marks[:-1]) > 0


def _cut(settled: Settled):
    def cut(batches):
        for slices in _slices(batches, 1, settled):
            level, key, segment = _joined(slices, 4, 2, 3)
            for (batch, a, b, data, offsets, found), twice in zip(slices, _each(slices, settled.same(level, key, segment))):
                gone = covered(data, offsets, found, twice, settled)
                upto = np.concatenate([[0], np.cumsum(gone)])
                enter = gone.copy()
                enter[1:] &= ~gone[:-1]
                inner = offsets[:-1][offsets[:-1] < len(data)]
                enter[inner] = gone[inner]
                runs = np.concatenate([[0], np.cumsum(enter)])
                kept = data[~gone].tobytes()
                removed = upto[offsets[1:]] - upto[offsets[:-1]]
                stops = offsets - upto[offsets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(offsets)), pa.array(removed), pa.array(runs[offsets[1:]] - runs[offsets[:-1]]), pa.array([kept[x:y] for x, y in zip(stops[:-1], stops[1:])], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row."""
    import atexit

    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits, shard_bits = (int(np.ceil(np.log2(max(64, size // each)))) for each in (BUCKET_BYTES, SHARD_BYTES))
    store = SharedArrays(table_path(spark, "repeats"))
    atexit.register(_forget, spark, store.uri)
    settled = Settled(store, bits)
    texts = rows.select("text")
    while True:
        pairs = texts.mapInArrow(trimmed(_count(settled)), "bucket int, blob binary").groupBy("bucket").applyInArrow(_settle_pairs(settled), "bucket int, blob binary")
        found = pairs.groupBy("bucket").applyInArrow(_settle_keys(settled), "hot long").agg(F.count("*").alias("n"), F.sum("hot").alias("hot")).first()
        settled = Settled(store, bits, settled.levels + 1)
        if not found["n"] and settled.levels == 1:
            return rows.mapInArrow(_plain, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
        if not found["hot"]:
            break
    # sorting costs far more than its bytes tell, so its tasks follow the size of the texts
    tasks = max(2 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    shards = texts.mapInArrow(trimmed(_gather(settled, shard_bits)), "bucket int, head binary, bytes binary").repartition(int(tasks), "bucket")
    parts = shards.groupBy("bucket").applyInArrow(trimmed(_search(bits)), "home int, key long, begin long, end long")
    parts.groupBy("home").applyInArrow(_store_parts(store), "bucket int").count()
    return rows.mapInArrow(trimmed(_cut(settled)), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def _plain(batches):
    """Rows of a table without any window."""
    for batch in batches:
        raw = [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
        zero = pa.array(np.zeros(len(raw), np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), zero, zero, pa.array(raw, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def digests(removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
