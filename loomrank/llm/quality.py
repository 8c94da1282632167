"""Quality selection by importance resampling over hashed n-gram models.

Two bag models over hashed features, one of target texts (labelled good) and one of all raw texts, give
every document the log ratio of its probabilities, taken over an average passage of its text (the mean over
all its features, so that one cut fits short and long texts). Gumbel noise keyed by the id is added and the k largest
sums stay (sampling without replacement in proportion to the importance weights). Features are hashed
words, word pairs, and the same for word shapes (case, digits, end mark, repetition of earlier words), so
shouting, stray marks and loops are seen whatever the words. k is the number of documents whose weight
reaches the cut that separates best the third of the labelled sample that the target model never saw.

Results for odd input: a null or wordless text has log weight 0; rows that tie with the k-th sum all stay;
without labels of both values every document stays; null ids share one noise value; an empty table gives an
empty result; ``select_quality`` passes all columns through unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import free_name, trimmed, written
from ._sample import kth_largest, labelled_sample
from ._text import mix, span_hashes, string_slices, words_of

FEATURES = 1 << 15
#: Weight of the raw model as the prior of the target model, in units of the target sample's features.
PRIOR = 1.0
#: Features that every text counts as, whatever its length: its weight is that of an average passage of it.
PASSAGE = 200.0
#: Share of the labelled good documents that the cut keeps at least.
KEEP_GOOD = 0.995

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B] = True
_LOWER[0x61:0x7B] = True
_LOWER[0x80:] = True
_DIGIT[0x30:0x3A] = True


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature number, text number) of every feature of a slice of texts."""
    starts, stops, text = words_of(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = span_hashes(data, starts, stops)
    count = lambda mask: (lambda c: c[stops] - c[starts])(np.concatenate([[0], np.cumsum(mask[data])]))
    upper, lower, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    size = stops - starts
    last, first = data[stops - 1].astype(np.int64), data[starts].astype(np.int64)
    mark = np.where(_UPPER[last] | _LOWER[last] | _DIGIT[last], 0, last)
    head = np.where(_UPPER[first], 1, np.where(_LOWER[first], 2, np.where(_DIGIT[first], 3, first)))
    same = lambda back: np.concatenate([np.zeros(min(back, len(words)), bool), (words[back:] == words[:-back]) & (text[back:] == text[:-back])])
    shape = np.stack([np.where(upper == 0, 0, np.where(lower == 0, 2, 1)), np.minimum(digit, 3), np.minimum(size - upper - lower - digit, 4), mark, head, same(1) + 2 * same(2), np.minimum(size, 2)])
    shapes = np.zeros(len(words), np.uint64)
    for row in shape:
        shapes = mix(shapes ^ (row.astype(np.uint64) + np.uint64(0x100)))
    pair = text[1:] == text[:-1]
    parts = [(words, text, 1), (mix(words[:-1] * np.uint64(3) ^ words[1:])[pair], text[1:][pair], 2), (shapes, text, 3), (mix(shapes[:-1] * np.uint64(3) ^ shapes[1:])[pair], text[1:][pair], 4)]
    hashed = np.concatenate([mix(h ^ np.uint64(salt << 56)) % np.uint64(FEATURES) for h, _, salt in parts]).astype(np.int64)
    return hashed, np.concatenate([t for _, t, _ in parts])


def _count(batches):
    """Partial feature counts of a partition: raw (all rows) and target (rows labelled good)."""
    totals = np.zeros((2, FEATURES), dtype=np.int64)
    for batch in batches:
        good = np.nan_to_num(batch.column(1).to_numpy(zero_copy_only=False).astype(float)) == 1
        for a, b, data, offsets in string_slices(batch.column(0)):
            number, text = features(data, offsets)
            totals[0] += np.bincount(number, minlength=FEATURES)
            totals[1] += np.bincount(number[good[a:b][text]], minlength=FEATURES)
    for kind in (0, 1):
        used = np.flatnonzero(totals[kind])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), kind, np.int32)), pa.array(used.astype(np.int32)), pa.array(totals[kind][used])], ["kind", "feature", "n"])


def log_ratios(docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of each feature; counts cover all rows, the table has ``FEATURES`` entries."""
    rows = docs.join(F.broadcast(sample.select("doc_id", "label")), "doc_id", "left").select("text", "label")
    counted = rows.mapInArrow(trimmed(_count), "kind int, feature int, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros((2, FEATURES))
    for kind, feature, n in counted:
        totals[kind, feature] = n
    return ratios_of(*totals)


def ratios_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The target model leans on the raw one where the sample is thin; features that no text has weigh 0."""
    p = raw / max(raw.sum(), 1.0)
    prior = PRIOR * max(target.sum(), 1.0)
    q = (target + prior * p) / (target.sum() + prior)
    return np.log(np.where(p > 0, q, 1.0)) - np.log(np.where(p > 0, p, 1.0))


def weigh(column: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """Log importance weight of each text: the mean log ratio of all its features, times ``PASSAGE``; 0 without any."""
    out = np.zeros(len(column))
    for a, b, data, offsets in string_slices(column):
        number, text = features(data, offsets)
        out[a:b] = PASSAGE * np.bincount(text, weights=ratios[number], minlength=b - a) / np.maximum(np.bincount(text, minlength=b - a), 1)
    return out


def gumbel(hashes: np.ndarray) -> np.ndarray:
    """A standard Gumbel draw for each 64-bit hash."""
    u = ((mix(hashes.view(np.uint64)) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return -np.log(-np.log(u))


def sortable(x: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _scorer(ratios: np.ndarray):
    def score(batches):
        for batch in batches:
            weight = weigh(batch.column(1), ratios)
            key = weight + gumbel(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(key), pa.array(sortable(key))], ["doc_id", "log_weight", "gumbel_key", "bits"])

    return score


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest labelled errors among those that keep ``KEEP_GOOD`` of the good ones."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)])
    passed = (~g).sum() - np.concatenate([[0], np.cumsum(~g)])
    cuts = np.concatenate([[-np.inf], (w[1:] + w[:-1]) / 2, [np.inf]])
    errors = np.where(lost <= (1 - KEEP_GOOD) * g.sum(), lost + passed, np.inf)
    return float(cuts[np.argmin(errors)])


def _fit(docs: DataFrame, labels: DataFrame):
    """(log ratios, scored rows, smallest sum that stays or None for all, cut)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(labels, "quality")
    tuning = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    ratios = log_ratios(docs, sample.where(~tuning))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("hash"))
    scored = written(rows.mapInArrow(trimmed(_scorer(ratios)), f"doc_id {kind}, log_weight double, gumbel_key double, bits long"), "weights")
    seen = np.array([tuple(r) for r in scored.join(F.broadcast(sample.where(tuning)), "doc_id").select("log_weight", "label").collect()], dtype=float).reshape(-1, 2)
    cut = best_cut(seen[:, 0], seen[:, 1] == 1)
    k = None if cut == -np.inf else scored.where(F.col("log_weight") >= cut).count()
    return ratios, scored, None if k is None else (kth_largest(scored, "bits", k) if k else np.iinfo(np.int64).max)


def quality_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, log_weight, gumbel_key, kept) for every row."""
    _, scored, least = _fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    return scored.select("doc_id", "log_weight", "gumbel_key", F.lit(True).alias("kept") if least is None else (F.col("bits") >= F.lit(int(least))).alias("kept"))


def select_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns as they were. Rows are weighed again where they lie, so nothing is shuffled."""
    ratios, _, least = _fit(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    if least is None:
        return docs
    schema, noise = docs.schema, free_name(docs, "_hash")

    def keep(batches):
        for batch in batches:
            at = batch.schema.get_field_index
            key = weigh(batch.column(at(text_col)), ratios) + gumbel(batch.column(at(noise)).to_numpy(zero_copy_only=False).astype(np.int64))
            plain = batch.select(schema.names)
            yield plain.filter(pa.array(sortable(key) >= least))

    return docs.withColumn(noise, F.xxhash64(id_col)).mapInArrow(trimmed(keep), schema)
