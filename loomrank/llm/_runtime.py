"""Session plumbing of the llm operators: shared storage, written tables, sizes."""

from __future__ import annotations

import atexit
import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.stages import _forget, shared_folder


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of a thousand, unless the session or its configuration says how many.

    Rows here are whole texts; smaller batches keep the buffers on both sides of a worker small. Spark itself
    bounds a batch's bytes (``maxBytesPerBatch``, 64 MB where it isn't set). Plans read the setting when they
    run, so it stays for the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, "1000")


def give_back() -> None:
    """Return freed memory to the system; a Python worker lives through many tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def trimmed(function):
    """A function over batches that gives its worker's freed memory back when a task ends."""

    @functools.wraps(function)
    def run(batches):
        yield from function(batches)
        give_back()

    return run


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/loomrank/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def parts_for(rows: int, each: int = 10_000) -> int:
    """Partitions of a table of so many rows at most: grows with the table, keeps small tables in few files."""
    return max(6, rows // each)


def written(df: DataFrame, name: str, compression: str = "snappy", parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors.

    ``parts`` merges shuffle partitions into so many files where there are more.
    """
    df = df.coalesce(parts) if parts else df
    spark = df.sparkSession
    bound_batches(spark)
    path = table_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``written``, with rows placed in ``buckets`` by the hash of ``key``: a later grouping by it moves none of them.

    Spark places rows so only by way of a catalog table; its entry goes once the files are known.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    table = f"loomrank_{path.rsplit('-', 1)[1]}"
    df.write.option("path", path).bucketBy(buckets, key).saveAsTable(table, format="parquet")
    atexit.register(_forget, spark, path)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found


def free_name(df: DataFrame, stem: str) -> str:
    """``stem``, made longer until no column of ``df`` begins with it: a prefix for columns that are only passed through."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def drop_written(df: DataFrame) -> None:
    """Delete the files below a DataFrame that ``written`` returned, once nothing reads it."""
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        if "/loomrank/" in path:
            _forget(df.sparkSession, path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
