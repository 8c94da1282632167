"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the session's checkpoint folder; in local mode without either a temporary folder."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or _OWN.get(sc.applicationId)
    if not given:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            given = known.get()
        elif sc.master.startswith("local"):
            given = "file://" + tempfile.mkdtemp(prefix="loomrank-")
            sc.setCheckpointDir(given)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[sc.applicationId] = given
    return given.rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone when the process ends
        pass


def kept(df: DataFrame) -> DataFrame:
    """The rows of ``df``, worked out once and written: later steps read them whatever executors are lost, and plans stay short."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomrank/{spark.sparkContext.applicationId}/stage-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)
