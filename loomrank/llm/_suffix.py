"""Suffix arrays with common prefixes by recursive induced sorting, on disk-backed scratch beyond a memory bound.

Every induction runs through a priority queue with a lane for each symbol (``_induce``); in the last one the
suffix tuples carry what they share with the tuple popped before (``Prefixes``), so the order of all suffixes
comes with its common prefixes and neighbours need not be compared again.
"""

from __future__ import annotations

import tempfile

import numpy as np

from ._text import mix, powers

#: Bytes of one scratch array that stay in memory; larger ones are maps of unnamed temporary files.
MEMORY = 16 << 20
#: Entries of scratch arrays that are worked on at once.
CHUNK = 1 << 17
#: Slots that one run pops at most.
RUN = 1 << 16
#: Common prefixes are told up to this length, and the mark of a slot that has none.
CAP, NONE = 200, 255
_BASE = 0xD1342543DE82EF95


def scratch(n: int, dtype, fill=None) -> np.ndarray:
    size = n * np.dtype(dtype).itemsize
    if size <= MEMORY:
        out = np.empty(n, dtype)
    else:
        with tempfile.TemporaryFile() as file:
            out = np.asarray(np.memmap(file, dtype=dtype, mode="w+", shape=(n,)))
    if fill is not None:
        out[:] = fill
    return out


class Spool:
    """An array of unknown length, put together from pieces; what passes the memory bound goes to an unnamed file."""

    def __init__(self, dtype):
        self.dtype, self.parts, self.held, self.n, self.file = np.dtype(dtype), [], 0, 0, None

    def add(self, piece: np.ndarray) -> None:
        piece = np.ascontiguousarray(piece, self.dtype)
        if len(piece):
            self.parts.append(piece)
            self.held += piece.nbytes
            self.n += len(piece)
            if self.held > MEMORY:
                self._flush()

    def _flush(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for piece in self.parts:
            self.file.write(piece.data.cast("B"))
        self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([np.empty(0, self.dtype), *self.parts])
        self._flush()
        self.file.flush()
        with self.file as file:
            return np.asarray(np.memmap(file, dtype=self.dtype, mode="r+", shape=(self.n,)))


def chunks(n: int, size: int = 0) -> list[tuple[int, int]]:
    size = max(size or CHUNK, 1)
    return [(a, min(a + size, n)) for a in range(0, n, size)]


def index_type(n: int):
    return np.int32 if n < 1 << 31 else np.int64


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the smallest and unique."""
    n = len(text)
    out = scratch(n, bool)
    out[n - 1] = True
    for a, b in reversed(chunks(n - 1)):
        here, after = text[a:b], text[a + 1 : b + 1]
        differs = np.flatnonzero(here != after)
        known = np.append(here[differs] < after[differs], out[b])  # a run up to the end of the chunk goes on behind it
        out[a:b] = known[np.searchsorted(differs, np.arange(b - a))]
    return out


def _starts(small: np.ndarray) -> np.ndarray:
    """Positions of the leftmost small suffixes."""
    out = Spool(index_type(len(small)))
    for a, b in chunks(len(small) - 1):
        out.add(np.flatnonzero(small[a + 1 : b + 1] & ~small[a:b]) + (a + 1))
    return out.array()


def _edges(text: np.ndarray) -> np.ndarray:
    """Where each symbol's suffixes begin in the order of all, and the end."""
    top = max(int(text[a:b].max()) for a, b in chunks(len(text)))
    out = scratch(top + 2, np.int64, 0)
    for a, b in chunks(len(text)):
        if top < CHUNK:
            out[1:] += np.bincount(text[a:b], minlength=top + 1)
        else:
            symbols, times = np.unique(text[a:b], return_counts=True)
            out[symbols.astype(np.int64) + 1] += times
    for a, b in chunks(len(out)):
        out[a:b] = np.cumsum(out[a:b]) + (out[a - 1] if a else 0)
    return out


def _shifted(edges: np.ndarray, by: int) -> np.ndarray:
    out = scratch(len(edges), np.int64)
    for a, b in chunks(len(edges)):
        out[a:b] = edges[a:b] + by
    return out


def _ranks(symbols: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Occurrences before each entry of the same symbol; ``order`` sorts the symbols, equal ones as they stand."""
    order = symbols.argsort(kind="stable") if order is None else order
    run = symbols[order]
    first = np.empty(len(run), bool)
    first[:1] = True
    np.not_equal(run[1:], run[:-1], out=first[1:])
    place = np.arange(len(run))
    begin = np.maximum.accumulate(np.where(first, place, 0))
    rank = np.empty(len(run), np.int64)
    rank[order] = place - begin
    return rank


class RangeMin:
    """Least values of ranges of a byte array that is filled from its start: minima of blocks, of blocks of blocks, and so on."""

    WIDTH = 64

    def __init__(self, values: np.ndarray):
        self.levels, self.full = [values], [0]
        while len(self.levels[-1]) > self.WIDTH:
            self.levels.append(scratch(-(-len(self.levels[-1]) // self.WIDTH), np.uint8, NONE))
            self.full.append(0)

    def extend(self, upto: int) -> None:
        """Entries before ``upto`` are final."""
        for level in range(1, len(self.levels)):
            a, b = self.full[level], upto // self.WIDTH
            for x, y in ((a + x, a + y) for x, y in chunks(b - a, CHUNK // self.WIDTH)):
                self.levels[level][x:y] = self.levels[level - 1][x * self.WIDTH : y * self.WIDTH].reshape(-1, self.WIDTH).min(axis=1)
            self.full[level], upto = b, b

    def _some(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima of ranges of at most a block."""
        out = np.full(len(a), NONE, np.uint8)
        values, step = self.levels[level], np.arange(self.WIDTH)
        for x, y in chunks(len(a), CHUNK // self.WIDTH):
            at = a[x:y, None] + step
            inside = at < b[x:y, None]
            out[x:y] = np.where(inside, values[np.where(inside, at, 0)], NONE).min(axis=1)
        return out

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least value of each range from a to before b, ``NONE`` of an empty one; all entries before b are final."""
        out = np.full(len(a), NONE, np.uint8)
        open_, a, b = np.arange(len(a)), a.copy(), b.copy()
        for level in range(len(self.levels)):
            top = level == len(self.levels) - 1
            head = b if top else np.minimum(b, -(-a // self.WIDTH) * self.WIDTH)
            out[open_] = np.minimum(out[open_], self._some(level, a, head))
            if top:
                break
            tail = np.maximum(head, b // self.WIDTH * self.WIDTH)
            out[open_] = np.minimum(out[open_], self._some(level, tail, b))
            go = np.flatnonzero(head < tail)
            open_, a, b = open_[go], head[go] // self.WIDTH, tail[go] // self.WIDTH
            if not len(open_):
                break
        return out


def _table_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least values of ranges (a, b] of a short array, from minima of all ranges of powers of two."""
    span = np.frexp((b - a).astype(float))[1] - 1
    rows = [values]
    for power in range(int(span.max(initial=0))):
        rows.append(np.minimum(rows[-1][: len(rows[-1]) - (1 << power)], rows[-1][1 << power :]))
    out = np.empty(len(a), np.uint8)
    for power, row in enumerate(rows):
        own = np.flatnonzero(span == power)
        out[own] = np.minimum(row[a[own] + 1], row[b[own] + 1 - (1 << power)])
    return out


class Prefixes:
    """Common-prefix values of one induction, kept beside its queue: what every entry shares with the entry popped before.

    Two neighbours of one lane that the induction put there share their symbol and what the entries that put
    them share, the least value between those. Where a lane begins, and where entries that were there before
    follow those of the induction, neighbours were put in different ways: these junctions, two a lane at most,
    are read from the text when they are popped.
    """

    def __init__(self, values: np.ndarray, begins: np.ndarray, filled: np.ndarray, text: np.ndarray):
        self.values, self.begins, self.text = values, begins, text
        self.old = _lane_firsts(filled, begins)
        self.least = RangeMin(values)
        self.last = scratch(len(begins), np.int64, -1)  # by symbol: the slot that pushed its last entry
        self.before = -1, -1  # slot and position of the entry popped last

    def popped(self, block: np.ndarray, done: int) -> None:
        """Settle the junctions among the slots that are popped."""
        at = np.flatnonzero(block >= 0)
        if not len(at):
            return
        at += done
        slot, position = self.before
        lanes = self.begins[slice(*np.searchsorted(self.begins, (slot + 1, done + len(block))))]
        old = self.old[slice(*np.searchsorted(self.old, (done, done + len(block))))]
        some = np.unique(np.searchsorted(at, np.concatenate([lanes, old])))
        some = some[some < len(at)]
        for a, b in chunks(len(some), CHUNK // 8):
            pick = some[a:b]
            earlier = block[at[np.maximum(pick - 1, 0)] - done].astype(np.int64)
            earlier[pick == 0] = position
            here = block[at[pick] - done].astype(np.int64)
            shared = shared_symbols(self.text, np.maximum(earlier, 0), here)
            self.values[at[pick]] = np.where(earlier < 0, 0, shared)
        self.before = int(at[-1]), int(block[at[-1] - done])

    def pushed(self, at: np.ndarray, symbol: np.ndarray, order: np.ndarray, done: int, size: int) -> np.ndarray:
        """What each pushed entry shares with the one before it in its lane; ``at`` are the slots of the run that push them, ``order`` sorts them by symbol."""
        ordered = symbol[order]
        first = np.ones(len(order), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        before = np.empty(len(order), np.int64)
        before[order[1:]] = at[order[:-1]] + done
        before[order[first]] = self.last[ordered[first]]
        shared = np.full(len(order), NONE, np.int64)  # the first of a lane is a junction
        own = self.values[done : done + size]
        inside = np.flatnonzero(before >= done)
        shared[inside] = _table_min(own, before[inside] - done, at[inside])
        across = np.flatnonzero((before < done) & (before >= 0))
        if len(across):
            self.least.extend(done)
            shared[across] = np.minimum(self.least.query(before[across] + 1, np.full(len(across), done)), np.minimum.accumulate(own)[at[across]])
        out = np.minimum(shared + 1, CAP)
        out[before < 0] = NONE
        ends = np.append(np.flatnonzero(first)[1:] - 1, len(order) - 1) if len(order) else np.zeros(0, np.int64)
        self.last[ordered[ends]] = at[order[ends]] + done
        return out.astype(np.uint8)


def _induce(queue: np.ndarray, text: np.ndarray, small: np.ndarray, wanted: bool, places: np.ndarray, prefixes: Prefixes | None) -> None:
    """Pop suffix tuples from a priority queue in order and push their predecessors of the wanted type.

    The queue is a disk-backed array with a lane for each symbol, as long as the symbol is frequent: a tuple's
    priority is its symbol, then its turn, and ``places`` has the next free slot of each lane. A tuple is a
    position, and beside it (``prefixes``) the common prefix with the tuple before. A run of slots is popped at
    once up to the first slot that the run itself fills, which gives the order of single pops.
    """
    n, done, size = len(queue), 0, 4096
    while done < n:
        size = min(size, n - done)
        block = queue[done : done + size]
        at = np.flatnonzero(block > 0)
        before = block[at] - 1
        keep = small[before] == wanted
        at, before = at[keep], before[keep]
        if len(at):
            symbol = text[before]
            order = symbol.argsort(kind="stable")
            target = places[symbol] + _ranks(symbol, order)
            reach = int(target.min()) - done
            if reach < size:
                part = np.searchsorted(at, reach)
                at, target, before, symbol, order = at[:part], target[:part], before[:part], symbol[:part], order[order < part]
                size = reach
        if prefixes is not None:
            prefixes.popped(queue[done : done + size], done)
        if len(at):
            if prefixes is not None:
                prefixes.values[target] = prefixes.pushed(at, symbol, order, done, size)
            queue[target] = before
            places[symbol] = target + 1  # of a symbol's targets the last one stays
        done += size
        size = min(max(96, size * 2), RUN)


def _lane_firsts(filled: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The first taken slot of each lane that has one."""
    slots, seen = Spool(np.int64), -1
    for a, b in chunks(len(filled)):
        at = np.flatnonzero(filled[a:b] >= 0) + a
        lane = np.searchsorted(begins, at, side="right") - 1
        fresh = np.ones(len(at), bool)
        fresh[1:] = lane[1:] != lane[:-1]
        fresh[:1] = lane[:1] != seen
        slots.add(at[fresh])
        seen = int(lane[-1]) if len(lane) else seen
    return slots.array()


def _turned(edges: np.ndarray) -> np.ndarray:
    """Where lanes begin in the queue turned round, the largest symbol's lane first."""
    out, n = scratch(len(edges) - 1, np.int64), int(edges[-1])
    for a, b in chunks(len(out)):
        out[a:b] = n - edges[len(edges) - 1 - np.arange(a, b)]
    return out


def _sorted_from(text: np.ndarray, small: np.ndarray, starts: np.ndarray, edges: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order, induced from the leftmost small ones in the order given; with ``shared`` also their common prefixes.

    ``shared`` is what each of ``starts`` shares with the one before. The first induction runs up the queue, the
    second one down it, as the same induction over the queue turned round.
    """
    n = len(text)
    queue = scratch(n, index_type(n), -1)
    places = _shifted(edges[1:], -1)
    values = None if shared is None else scratch(n, np.uint8, NONE)
    for a, b in reversed(chunks(len(starts))):
        block = starts[a:b][::-1]
        symbol = text[block]
        target = places[symbol] - _ranks(symbol)
        queue[target] = block
        places[symbol] = target - 1
        if values is not None:
            values[target] = shared[a:b][::-1]
    prefixes = None if values is None else Prefixes(values, edges[:-1], queue, text)
    _induce(queue, text, small, False, _shifted(edges[:-1], 0), prefixes)
    del prefixes
    for a, b in chunks(n):
        part = queue[a:b]
        part[(part >= 0) & small[part]] = -1
    queue[0] = n - 1
    down = None
    if values is not None:
        above = scratch(n, np.uint8, NONE)  # what an entry shares with the next larger one
        for a, b in chunks(n - 1):
            there = np.flatnonzero((queue[a:b] >= 0) & (queue[a + 1 : b + 1] >= 0)) + a
            above[there] = values[there + 1]
        down = Prefixes(above[::-1], _turned(edges), queue[::-1], text)
    places = scratch(len(edges) - 1, np.int64)
    for a, b in chunks(len(places)):
        places[a:b] = n - edges[a + 1 : b + 1]
    places[text[n - 1]] = n  # the last symbol is in its place
    _induce(queue[::-1], text, small, True, places, down)
    if values is None:
        return queue, None
    for a, b in reversed(chunks(n)):
        values[max(a, 1) : b] = above[max(a, 1) - 1 : b - 1]
    values[0] = 0
    return queue, values


def shared_symbols(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree from a and from b on, up to ``CAP``; the last symbol is unique."""
    out = np.zeros(len(a), np.uint8)
    open_, step, n = np.arange(len(a)), np.arange(8), len(text)
    for at in range(0, CAP, 8):
        x, y = a[open_, None] + at + step, b[open_, None] + at + step
        same = (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (x < n) & (y < n)
        agree = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        out[open_] = at + agree
        open_ = open_[agree == 8]
        if not len(open_):
            break
    return np.minimum(out, CAP)


def _names(text: np.ndarray, small: np.ndarray, starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Each start's name and the number of names: equal substrings from one start to the next get one name."""
    n = len(text)
    total, back = scratch(n + 1, np.uint64), scratch(n, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    step, step_back = powers(_BASE, min(n, CHUNK)), powers(inverse, min(n, CHUNK))
    total[0] = 0
    for a, b in chunks(n):
        up, down = np.uint64(pow(_BASE, a, 1 << 64)), np.uint64(pow(inverse, a, 1 << 64))
        total[a + 1 : b + 1] = np.cumsum((text[a:b].astype(np.uint64) * np.uint64(2) + small[a:b] + np.uint64(1)) * (step[: b - a] * up)) + total[a]
        back[a:b] = step_back[: b - a] * down
    out = scratch(len(starts), index_type(len(starts)))
    name, last = 0, None
    for a, b in chunks(len(order)):
        at = order[a:b].astype(np.int64)
        number = np.searchsorted(starts, order[a:b])
        stop = np.where(number + 1 < len(starts), starts[np.minimum(number + 1, len(starts) - 1)], n - 1).astype(np.int64) + 1
        value = mix((total[stop] - total[at]) * back[at]) + (stop - at).astype(np.uint64)
        fresh = np.concatenate([[last is not None and value[0] != last], value[1:] != value[:-1]])
        own = name + np.cumsum(fresh)
        out[number] = own
        name, last = int(own[-1]), value[-1]
    return out, name + 1


def _order_of_starts(text: np.ndarray, small: np.ndarray, starts: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the leftmost small suffixes as numbers of ``starts``, name of each): sorted by one induction up to the next one, named, and ordered by recursion on the names."""
    n = len(text)
    queue, _ = _sorted_from(text, small, starts, edges)
    found = Spool(index_type(n))
    for a, b in chunks(n):
        at = queue[a:b][queue[a:b] > 0]
        found.add(at[small[at] & ~small[at - 1]])
    del queue
    order = found.array()
    del found
    reduced, names = _names(text, small, starts, order)
    if names < len(order):
        return _doubled(reduced) if len(reduced) * 16 <= MEMORY else suffix_array(reduced), reduced
    inner = scratch(len(starts), index_type(n))
    for a, b in chunks(len(starts)):
        inner[a:b] = np.searchsorted(starts, order[a:b])
    return inner, reduced


def _doubled(names: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a short row of names in order, by prefix doubling; the last name must be 0 and stand nowhere else.

    The end of the recursion, for names within the memory bound: an induction over them would pop runs of a few each.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    rank, slots, key, reach = np.empty(n, np.int64), np.arange(n), names[order], 1
    while len(slots):
        first = np.ones(len(slots), bool)
        np.not_equal(key[1:], key[:-1], out=first[1:])
        rank[order[slots]] = np.maximum.accumulate(np.where(first, slots, 0))  # a group's first slot
        alone = first.copy()
        alone[:-1] &= first[1:]
        slots = slots[~alone]
        at = order[slots]
        key = rank[at] * n + rank[np.minimum(at + reach, n - 1)]  # a suffix that meets the end is alone before
        by = key.argsort()
        order[slots], key = at[by], key[by]
        reach *= 2
    return order.astype(index_type(n))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order.

    ``text`` holds small non-negative integers; its last symbol must be 0 and stand nowhere else. The leftmost
    small suffixes are ordered by induction and recursion, a second induction gives the order of all suffixes.
    All arrays of the text's length are scratch, worked on in chunks.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    small = _types(text)
    starts, edges = _starts(small), _edges(text)
    inner, _ = _order_of_starts(text, small, starts, edges)
    order = _taken(starts, inner)
    del inner
    return _sorted_from(text, small, order, edges)[0]


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = scratch(len(at), values.dtype)
    for a, b in chunks(len(at)):
        out[a:b] = values[at[a:b]]
    return out


def _shared_by_names(text: np.ndarray, starts: np.ndarray, reduced: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """What each of the ordered leftmost small suffixes shares with the one before: equal names first, then the text behind them."""
    out = scratch(len(inner), np.uint8, 0)
    m = len(reduced)
    padded = scratch(m + 7, reduced.dtype)
    for a, b in chunks(m):
        padded[a:b] = reduced[a:b]
    padded[m:] = -np.arange(1, 8)  # equal to no name, nor to each other
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for a, b in chunks(len(inner) - 1, CHUNK // 8):
        x, y = inner[a:b].astype(np.int64), inner[a + 1 : b + 1].astype(np.int64)
        names = np.zeros(b - a, np.int64)
        open_ = np.arange(b - a)
        while len(open_):
            same = eight[x[open_] + names[open_]] == eight[y[open_] + names[open_]]
            agree = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
            names[open_] += agree
            done = starts[x[open_] + names[open_]].astype(np.int64) - starts[x[open_]]  # the last name is unique
            open_ = open_[(agree == 8) & (done < CAP)]
        length = starts[x + names].astype(np.int64) - starts[x]
        rest = np.flatnonzero(length < CAP)
        length[rest] += shared_symbols(text, starts[x[rest] + names[rest]].astype(np.int64), starts[y[rest] + names[rest]].astype(np.int64))
        out[a + 1 : b + 1] = np.minimum(length, CAP)
    return out


def suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start positions of all suffixes in order, what each shares with the one before, up to ``CAP``).

    As ``suffix_array``; the last induction also carries the common prefixes, from those of the leftmost small
    suffixes, which the names of the recursion tell.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    small = _types(text)
    starts, edges = _starts(small), _edges(text)
    inner, reduced = _order_of_starts(text, small, starts, edges)
    shared = _shared_by_names(text, starts, reduced, inner)
    del reduced
    order = _taken(starts, inner)
    del inner
    return _sorted_from(text, small, order, edges, shared)
