import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from loomrank.llm import _suffix, suffix_dedup


def blocks(rows, each):
    for a in range(0, len(rows), each):
        key, start, seg, again, raw = zip(*rows[a : a + each])
        head = suffix_dedup._zip(np.zeros(len(key), np.uint64), np.array(key, "<u8"), np.array(start, "<i8"), np.array(seg, "<u8"), np.array(again, np.uint8), np.array(list(map(len, raw)), "<u4"))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([0], pa.int32()), "head": pa.array([head], pa.binary()), "bytes": pa.array([zstandard.compress(b"".join(raw))], pa.binary())})


def expected(rows):
    places = defaultdict(list)
    kept = list({(r[2] if r[3] else (i, r[2])): r for i, r in reversed(list(enumerate(rows)))}.values())
    for k, row in enumerate(kept):
        for at in range(len(row[4]) - 199):
            places[row[4][at : at + 200]].append((k, at))
    twice = sorted(p for ps in places.values() if len(ps) > 1 for p in ps if not kept[p[0]][3])
    out = []
    for k, at in twice:
        key, begin = kept[k][0], kept[k][1] + at
        if out and out[-1][0] == (k, key) and out[-1][2] == begin + 199:
            out[-1] = (out[-1][0], out[-1][1], begin + 200)
        else:
            out.append(((k, key), begin, begin + 200))
    return sorted((key, begin, end) for (_, key), begin, end in out)


def shard(rng, n):
    core = [bytes(rng.randrange(256) for _ in range(300)) for _ in range(4)]
    rows = []
    for i in range(n):
        base, a = rng.choice(core), rng.randrange(60)
        raw = base[a : a + rng.randint(200, 240)] if i % 3 else bytes([i % 256]) * rng.randint(200, 260)
        seg = int.from_bytes(raw[:8], "little") if i % 5 == 0 else i
        rows.append((i + 1, 7 * i, seg, i % 5 == 0, raw))
    return rows


@pytest.mark.parametrize(("memory", "chunk", "seen", "segments"), [(32 << 20, 1 << 20, 1 << 18, 50_000), (0, 7, 2, 3), (100, 64, 0, 1)])
def test_shard_in_small_chunks_on_disk(monkeypatch, memory, chunk, seen, segments):
    monkeypatch.setattr(_suffix, "MEMORY", memory)
    monkeypatch.setattr(_suffix, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "SEEN", seen)
    monkeypatch.setattr(suffix_dedup, "SEGMENTS", segments)
    rows = shard(random.Random(6), 40)
    got = [tuple(r[c] for c in ("key", "begin", "end")) for b in suffix_dedup._search(4)(blocks(rows, 9)) for r in b.to_pylist()]
    assert sorted(got) == expected(rows) and got


def test_shard_much_larger_than_its_memory(monkeypatch):
    for name, value in (("MEMORY", 1 << 15), ("CHUNK", 1 << 13), ("RUN", 1 << 13)):
        monkeypatch.setattr(_suffix, name, value)
    monkeypatch.setattr(suffix_dedup, "SEGMENTS", 200)
    noise = np.random.default_rng(1).integers(0, 256, 3 << 20, dtype=np.uint8)
    noise[2_000_020:2_100_020] = noise[:100_000]
    rows = [(i + 1, 0, i, False, noise[a : a + 250].tobytes()) for i, a in enumerate(range(0, len(noise) - 250, 250))]
    suffix_dedup._search(4)(iter(()))
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in suffix_dedup._search(4)(blocks(rows, 50)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print("peak", peak)
    assert found == 800 and peak < len(noise)


def test_buckets_are_read_once_for_many_slices(monkeypatch):
    """A slice of text has segments in all buckets; reading each of them for every slice made time grow with both."""
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 12)
    asked = []

    class Store:
        def get(self, name):
            asked.append(name)

    settled = suffix_dedup.Settled(Store(), 6, 1)
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(200)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": texts[a : a + 50]}) for a in range(0, 200, 50)]
    got = [r for b in suffix_dedup._cut(settled)(iter(batches)) for r in b.to_pylist()]
    assert [r["kept"].decode() for r in got] == texts and not any(r["n_removed"] for r in got)
    assert len([n for n in asked if n.startswith("same-")]) <= 64


@pytest.mark.parametrize("names", [[0], [1, 0], [3, 3, 3, 3, 0], [5, 1, 5, 1, 5, 1, 0], [2, 7, 2, 7, 9, 2, 7, 2, 7, 9, 0]])
def test_order_of_names_in_memory(names):
    assert _suffix._doubled(np.array(names, np.int32)).tolist() == sorted(range(len(names)), key=lambda i: names[i:])
