"""Near-duplicate detection by SuperMinHash, banding, verification on full sets and union-find.

A document's set holds the distinct 5-word shingles of its lower-cased (A-Z) white-space words; a text of
fewer words has one shingle, the whole sequence. Two documents are linked when
100 * |intersection| >= percent * |union|; links found by banding are confirmed on the full sets.

Results for odd input: a null, empty or wordless text has an empty set, is linked with nothing and is its
own component; equal sets are one node whatever their number; rows that repeat a doc_id share its
component; a component whose ids are all null has a null component_id and its rows count as kept; an empty
table gives an empty result; further columns are ignored. A text longer than a batch is a batch of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._runtime import parts_for, trimmed, written
from ._text import mix, string_slices, word_hashes

SHINGLE = 5
#: Signature length, and the most that all bands may miss at the similarity asked for.
SLOTS, MISS = 256, 1e-4
#: similarity as a whole percentage of the union
PERCENT = 85

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    words, text = word_hashes(data, offsets)
    count = len(offsets) - 1
    first = np.searchsorted(text, np.arange(count + 1))
    n = np.diff(first)
    if len(words) >= size:
        runs = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for i in range(size):
            runs = runs * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : len(words) - size + 1 + i]
        runs = mix(runs)
    sets = []
    for i in range(count):
        if n[i] >= size:
            sets.append(np.unique(runs[first[i] : first[i + 1] - size + 1]))
        elif n[i]:
            whole = np.uint64(n[i])
            for w in words[first[i] : first[i + 1]]:
                whole = mix(np.asarray([whole ^ w]))[0]
            sets.append(np.asarray([whole]))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def superminhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (one row a set, ``slots`` unsigned longs); empty sets keep the largest value.

    Every element walks its own random permutation of the slots; the value at step j lies in [j, j + 1), so
    a slot filled at an earlier step is final. A set whose slots are all filled leaves the walk.
    """
    total = len(sets)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full(total * slots, top, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return sig.reshape(total, slots)
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(total), sizes)
    open_ = np.ones(len(items), dtype=bool)
    order: np.ndarray | None = None
    at = np.arange(0)
    for j in range(slots):
        draw = mix(items + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32))
        pick = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, j]
        np.minimum.at(sig, owner * slots + slot, value)
        live = np.unique(owner)
        unfilled = np.zeros(total, dtype=bool)
        unfilled[live] = (sig.reshape(total, slots)[live] == top).any(axis=1)
        open_ = unfilled[owner]
        if not open_.any():
            break
        if order is None:
            items, owner, pick = items[open_], owner[open_], pick[open_]
            at = np.arange(len(items))
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(items), 1))
            order[at, pick] = 0
        elif not open_.all():
            items, owner, order = items[open_], owner[open_], order[open_]
            at = np.arange(len(items))
    return sig.reshape(total, slots)


def band_rows(percent: int) -> int:
    """Rows of a band: the most with which all bands miss a pair of this similarity with probability ``MISS`` at most.

    32 bands of 8 at 85 (4e-5), 42 bands of 6 at 80 (3e-6).
    """
    for rows in range(SLOTS, 1, -1):
        if (1 - (percent / 100) ** rows) ** (SLOTS // rows) <= MISS:
            return rows
    return 1


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature; equal keys of different bands don't meet."""
    bands = sig.shape[1] // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (len(sig), bands)).copy()
    for r in range(rows):
        keys = mix(keys ^ parts[:, :, r])
    return keys


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit identity of each set."""
    sums = np.array([(mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), len(s)) for s in sets], dtype=np.uint64).reshape(-1, 3)
    return mix(sums[:, 0] ^ mix(sums[:, 1] ^ mix(sums[:, 2])))


def _sign(percent: int):
    rows = band_rows(percent)

    def sign(batches):
        for batch in batches:
            for a, b, data, offsets in string_slices(batch.column(1), 1 << 18):
                sets = shingle_sets(data, offsets)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                keys = _band_keys(superminhash(sets), rows)
                flat = pa.array(_as_long(keys.ravel()))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, keys.shape[1]), pa.int32()), flat)
                nodes = pa.array(_as_long(_nodes(sets)), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sizes), nodes, bands], ["doc_id", "text_hash", "n", "node", "bands"])

    return sign


def _make_sets(batches):
    for batch in batches:
        for a, b, data, offsets in string_slices(batch.column(1), 1 << 18):
            sets = shingle_sets(data, offsets)
            stops = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            flat = pa.array(_as_long(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(stops, pa.int32()), flat)], ["node", "items"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the written (a, b) pairs whose full sets are similar enough.

    ``a`` may be a hub of any number of pairs: both sides of its join are plain exchanges of written tables,
    which adaptive execution splits where they are skewed.
    """
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
    shared = F.size(F.array_intersect("items_a", "items_b"))
    sized = both.select("a", "b", shared.alias("shared"), (F.size("items_a") + F.size("items_b")).alias("sum"))
    return sized.where(F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("sum") - F.col("shared"))).select("a", "b")


def _possible(n: str, m: str, percent: int):
    """Set sizes that allow the similarity."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def links(docs: DataFrame, nodes: DataFrame, parts: int, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all nodes that have a link.

    Buckets that two or more sets share are searched from their most central set (the one whose buckets are
    largest): a star of comparisons joins a group of near copies without its pairs. Sets of buckets that still
    hold several components then go through ``_rest``, which misses no pair of them, so no pair of sets that
    share a band and could change a component goes unseen.
    """
    exploded = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = written(exploded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "buckets", parts=parts)
    mass = F.sum("c").over(Window.partitionBy("node")).alias("mass")  # a node has one row a band
    central = written(exploded.join(shared, "key").select("key", "node", "n", mass), "central", parts=parts)
    need = central.select("node").distinct().join(nodes.select("node", "rep"), "node").select("node", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"))
    texts = docs.withColumn("hash", F.xxhash64("text"))
    # a repeated row is one set: _rest counts on one row an item and node
    one = texts.join(need, texts["doc_id"].eqNullSafe(need["id"]) & (texts["hash"] == need["hash"])).select("node", "text").dropDuplicates(["node"])
    sets = written(one.mapInArrow(trimmed(_make_sets), "node long, items array<long>"), "sets", parts=parts)

    hubs = written(central.groupBy("key").agg(F.max(F.struct("mass", "n", "node")).alias("top")).select("key", F.col("top.node").alias("hub"), F.col("top.n").alias("hub_n")), "hubs", parts=parts)
    met = central.join(hubs, "key").where(F.col("node") != F.col("hub"))
    pairs = written(met.select(F.col("hub").alias("a"), F.col("node").alias("b"), _possible("n", "hub_n", percent).alias("fits")).distinct(), "pairs", parts=parts)
    edges = written(_verified(pairs.where("fits").select("a", "b"), sets, percent), "edges")  # parts of a split hub stay apart
    roots = written(components(edges), "roots", parts=parts)

    # a bucket is settled when all of it lies in its hub's component; the sets of all others are open
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    labelled = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left").select("a", "b", F.coalesce("root_a", "a").alias("label_a"), F.coalesce("root_b", "b").alias("label_b"))
    labelled = written(labelled, "labelled", parts=parts)
    hot = written(labelled.where("label_a <> label_b").select("a", "label_a").distinct(), "unsettled", parts=parts)
    open_ = labelled.join(hot.select("a"), "a", "left_semi").select(F.col("b").alias("node"), F.col("label_b").alias("label")).unionByName(hot.toDF("node", "label")).distinct()
    more = written(_verified(written(_rest(open_, sets, parts, percent), "rest", parts=parts), sets, percent), "more_edges")
    if not more.limit(1).count():
        return roots
    return written(components(edges.unionByName(more)), "roots", parts=parts)


def _rest(open_: DataFrame, sets: DataFrame, parts: int, percent: int) -> DataFrame:
    """All (a, b) pairs of open sets of different labels that can be similar enough, by prefix filtering.

    Items are ordered rarest first. Two sets as similar as asked share an item among the first
    n - ceil(n * percent / 100) + 1 of either, so only sets that share a rare item meet: sets that have nothing but a
    common passage in common don't.
    """
    items = written(sets.join(open_, "node").select("node", "label", F.size("items").alias("n"), F.explode("items").alias("item")), "items", parts=parts)
    often = written(items.groupBy("item").agg(F.count("*").alias("c")).where("c > 1"), "often", parts=parts)
    ranked = items.join(often, "item", "left").select("node", "label", "n", "item", F.coalesce("c", F.lit(1)).alias("c"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    place = F.row_number().over(Window.partitionBy("node").orderBy("c", "item"))
    first = written(ranked.withColumn("place", place).where((F.col("place") <= length) & (F.col("c") > 1)).select("node", "label", "n", "item", (F.col("n") - F.col("place") + 1).alias("left")), "prefixes", parts=parts)
    other = first.select(F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("m"), "item", F.col("left").alias("left_b"))
    # what the first common item and all behind it can give must be enough: (100 + percent) |a and b| >= percent (|a| + |b|)
    enough = F.lit(100 + percent) * F.least("left", "left_b") >= F.lit(percent) * (F.col("n") + F.col("m"))
    met = first.join(other, "item").where((F.col("node") < F.col("b")) & (F.col("label") != F.col("label_b")) & _possible("n", "m", percent) & enough)
    return met.select(F.col("node").alias("a"), "b").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, node, top) for every row; ``top`` is the representative row of its group."""
    key = docs.schema[id_col].dataType.simpleString()
    parts = parts_for(docs.count())
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(
        docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(trimmed(_sign(percent)), f"doc_id {key}, text_hash long, n long, node long, bands array<long>"), "signed"
    )
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("rep")
    nodes = written(signed.where("node is not null").groupBy("node").agg(rep, F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes", parts=parts)
    roots = links(docs, nodes, parts, percent)
    placed = written(nodes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "placed", parts=parts)
    least = written(placed.groupBy("root").agg(F.min("rep").alias("top")), "least", parts=parts)
    owner = written(placed.select("node", "root").join(least, "root").select("node", "top"), "owner", parts=parts)
    return signed.select("doc_id", "text_hash", "n", "node").join(owner, "node", "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row."""
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id"))
    return _grouped(docs, id_col, text_col, percent).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group, rows without an id as they are.

    Rows that share an id but not their text are told apart by its hash; a repeated row stays once.
    """
    named = docs.where(F.col(id_col).isNotNull())
    top = F.col("node").isNull() | ((F.col("doc_id") == F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash")))
    kept = written(_grouped(named, id_col, text_col, percent).where(top).select("doc_id", "text_hash").distinct(), "kept", parts=parts_for(named.count()))
    stay = named.join(kept, (named[id_col] == kept["doc_id"]) & (F.xxhash64(named[text_col]) == kept["text_hash"]), "left_semi")
    return stay.dropDuplicates([id_col, text_col]).unionByName(docs.where(F.col(id_col).isNull()))
