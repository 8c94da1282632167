"""Nearest neighbours by randomly rotated one-bit codes, reranked under an error bound.

Vectors are scaled to length 1 and turned by one random rotation; a vector's code is the signs of its
coordinates, packed to bits, with two scalars: its length and the inner product f of the turned vector with
its code. estimate = <code, turned query> / f is an unbiased guess of the cosine whose error is bounded by a
multiple of sqrt((1 - f * f) / (f * f * (d - 1))). Every vector is encoded once; codes, scalars and the
vectors as they came lie in blocks in the shared folder, which workers map. Queries are dealt to blocks too
and each meets every group of code blocks; only queries are shuffled. In a group, the exact cosines of the
best guesses give the k-th best so far, and the vectors whose upper bound reaches it are fetched and reranked
by the exact cosine; a group returns at most k rows a query.

Results for odd input: vectors that are null, zero, or hold null or non-finite components take no part, as
query or as candidate; components may be as small or large as doubles go (vectors are scaled by a power of
two, which changes no cosine); a null id takes no part; vectors of different lengths are never compared;
ties go to the smaller id; rows that repeat an id are candidates each, but never of their own id; with fewer
than k candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import atexit
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._runtime import _forget, bound_batches, free_name, table_path
from ._shared_arrays import SharedArrays

#: Rows of a group of code blocks and of a block of queries; they bound the memory of a task.
CANDIDATES, QUERIES = 16_384, 256
#: Searches of a block of queries in a group that one task makes.
SEARCHES = 4
#: Best guesses whose exact cosines set the bar, for each neighbour asked for.
FIRST = 4
#: Width of the error bound in standard deviations.
EPSILON = 3.0
SEED = 20_240_611


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that the largest component of each lies between a half and 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _running(x: np.ndarray) -> np.ndarray:
    return np.add.accumulate(x, axis=-1)[..., -1]


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(_running(vectors * vectors))


def encode(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, inner product of each turned unit vector with its code)."""
    turned = units @ rotation(units.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(units.shape[1])


def estimate(codes: np.ndarray, fit: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimated cosine of every unit query with every coded vector, error bound of each vector)."""
    d = units.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    turned = (units @ rotation(d)).astype(np.float32)
    safe = np.maximum(fit, 1e-12)
    bound = EPSILON * np.sqrt(np.maximum(1 - safe * safe, 0) / (safe * safe * max(d - 1, 1))) + 1e-5
    return (turned @ signs.T) / (np.sqrt(d) * safe), bound


def cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Exact cosines in double precision, summed from the first component to the last: equal vectors tie exactly."""
    return _running(vectors * query) / (norms * norm)


class Block:
    """Candidates of one length: ids, codes and scalars, and the vectors as they came."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        own = scaled(vectors.astype(np.float64))
        self.ids, self.vectors, self.norms = ids, vectors, lengths(own)
        self.codes, self.fit = encode(own / self.norms[:, None])

    def arrays(self) -> dict[str, np.ndarray]:
        return {"ids": self.ids, "vectors": self.vectors.ravel(), "norms": self.norms, "codes": self.codes.ravel(), "fit": self.fit}

    @classmethod
    def of(cls, group: dict[str, np.ndarray]) -> "Block":
        block = cls.__new__(cls)
        n = len(group["ids"])
        block.ids, block.norms, block.fit = group["ids"], group["norms"], group["fit"]
        block.vectors, block.codes = group["vectors"].reshape(n, -1), group["codes"].reshape(n, -1)
        return block

    def fetch(self, at: np.ndarray) -> np.ndarray:
        return scaled(self.vectors[at].astype(np.float64))


def search(block: Block, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, cosine) of the k nearest of each query within one block of candidates."""
    queries = scaled(queries)
    norms = lengths(queries)
    guess, bound = estimate(block.codes, block.fit, queries / norms[:, None])
    out: list[tuple[np.ndarray, ...]] = []
    for qid, q, qn, own in zip(query_ids, queries, norms, guess):
        own = np.where(block.ids != qid, own, -np.inf)
        first = np.argpartition(-own, FIRST * k)[: FIRST * k] if len(own) > FIRST * k else np.arange(len(own))
        first = first[own[first] > -np.inf]
        exact = block.fetch(first) @ q / (block.norms[first] * qn)
        floor = np.partition(exact, len(exact) - k)[len(exact) - k] - 1e-9 if len(exact) > k else -np.inf
        chosen = np.flatnonzero((own + bound >= floor) & (own > -np.inf))
        chosen = np.union1d(chosen, first)
        near = block.fetch(chosen)
        exact = near @ q / (block.norms[chosen] * qn)
        if len(exact) > k:  # sums in order only for those that can be among the k best
            some = np.flatnonzero(exact >= np.partition(exact, len(exact) - k)[len(exact) - k] - 1e-9)
            chosen, near = chosen[some], near[some]
        exact = cosines(near, block.norms[chosen], q, qn)
        best = np.lexsort((block.ids[chosen], -exact))[:k]
        out.append((np.full(len(best), qid), block.ids[chosen][best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _store_blocks(store: SharedArrays, rows: int):
    """Encode the vectors of a partition in blocks of one length each; return (d, block, rows)."""

    def write(batches):
        part = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        made = 0

        def put(d: int) -> pa.RecordBatch:
            nonlocal made
            ids, vectors = (np.concatenate(c) for c in zip(*held.pop(d)))
            store.write(f"block-{part}-{made}", **Block(ids, vectors).arrays())
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([f"block-{part}-{made - 1}"]), pa.array([len(ids)], pa.int64())], ["d", "block", "n"])

        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                own = batch.filter(pa.array(sizes == d))
                held[d].append((own.column(0).to_numpy(), _matrix(own.column(1))))
                if sum(len(i) for i, _ in held[d]) >= rows:
                    yield put(d)
        for d in list(held):
            yield put(d)

    return write


def _search_group(store: SharedArrays, groups: dict[tuple[int, int], list[str]], k: int):
    names = ["query_id", "vec_id", "score"]

    def find(table: pa.Table) -> pa.Table:
        ids, queries = table.column("id").to_numpy(), _matrix(table.column("v"))
        found = [search(Block.of(store.read(name)), ids, queries, k) for name in groups[table.column("d")[0].as_py(), table.column("g")[0].as_py()]]
        query, vec, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) if len(query) else np.zeros(0, np.int64)
        return pa.table([pa.array(x[place < k]) for x in (query, vec, score)], names=names)

    return find


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row by cosine, nearest first.

    The driver holds the name of each code block, one for ``candidates`` rows or a partition.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    element = vectors.schema[vector_col].dataType.elementType
    kind = "float" if isinstance(element, FloatType) else "double"  # others as doubles
    flag = free_name(vectors, "_query")
    v = F.col(vector_col) if vectors.schema[vector_col].dataType == ArrayType(FloatType()) else F.col(vector_col).cast(f"array<{kind}>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.withColumn(flag, is_query).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(flag, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    store = SharedArrays(table_path(spark, "codes"))
    atexit.register(_forget, spark, store.uri)
    blocks = sorted(tuple(r) for r in rows.select("id", "v").mapInArrow(_store_blocks(store, candidates), "d int, block string, n long").collect())
    groups, last, size = defaultdict(list), {}, 0
    for d, name, n in blocks:
        if d not in last or size >= candidates:
            last[d], size = last.get(d, -1) + 1, 0
        groups[d, last[d]].append(name)
        size += n
    asked = rows.where("q").select(F.size("v").alias("d"), "id", F.col("v").cast("array<double>").alias("v"))
    parts = max(1, -(-asked.count() // queries))
    met = spark.createDataFrame(list(groups) or [(0, 0)], "d int, g int")
    dealt = asked.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")).join(F.broadcast(met), "d")  # a row for each group of blocks
    # a search costs far more than its bytes tell, so its tasks follow the number of searches
    tasks = max(2 * spark.sparkContext.defaultParallelism, len(groups) * parts // SEARCHES)
    found = dealt.repartition(tasks, "d", "qb", "g").groupBy("d", "qb", "g").applyInArrow(_search_group(store, dict(groups), k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
