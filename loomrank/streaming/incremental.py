"""Incremental builds: new instance files are projected and appended to the corpus as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.sinks import replace_source


def stream_corpus(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Append transformed rows of new files; the checkpoint makes every file count once."""
    rows = transform(spark.readStream.schema(schema).parquet(source))
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_blocks(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, block: str = "local") -> StreamingQuery:
    """Replace one source's block of the corpus by each batch; a batch that runs twice changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        replace_source(batch, target, block)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
