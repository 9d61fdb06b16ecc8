"""Incremental runs: micro-batches of new files, failed items retried from the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import is_pending
from ..sources import ledger
from ..sources.files import stream_assets

REGISTRY = "name string, status string, attempts int, updated_seq long"


def run_available(spark: SparkSession, folder: str, schema: str, registry: str, checkpoint: str, process: Callable[[DataFrame, DataFrame], DataFrame], files: int = 50) -> None:
    """Process all files of rows there are, `files` at a time, then retry what failed in earlier runs and was not retried in this one.

    process(new rows, retry entries) gives registry rows (name, status, attempts).  A micro-batch that was committed before
    a crash and is replayed after it is left out.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    step = _step(spark, registry, process)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    step(spark.createDataFrame([], schema), None)


def run_folder(spark: SparkSession, folder: str, registry: str, checkpoint: str, process: Callable[[DataFrame, DataFrame], DataFrame], files: int = 50, content: bool = True) -> None:
    """The same for a folder of pictures, whose rows are name, path, length and content."""
    stream = stream_assets(spark, folder, f"{checkpoint}-lists", files, content)
    step = _step(spark, registry, process)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    step(spark.createDataFrame([], stream.schema), None)


def _step(spark: SparkSession, registry: str, process: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int | None], None]:
    newest = lambda state: state.agg(F.coalesce(F.max("updated_seq"), F.lit(-1))).first()[0]
    start = newest(ledger.read(spark, registry, REGISTRY))

    def step(new: DataFrame, number: int | None) -> None:
        if number is not None and number == ledger.committed_batch(spark, registry):
            return
        state = ledger.read(spark, registry, REGISTRY)
        # Entries of this run wait for the next one.
        again = state.where((F.col("status") == "ERROR") & is_pending(F.col("status"), F.col("attempts")) & (F.col("updated_seq") <= start))
        if number is None and again.isEmpty():
            return
        rows = process(new, again).withColumn("updated_seq", F.lit(newest(state) + 1).cast("long"))
        ledger.commit(rows.select("name", "status", "attempts", "updated_seq"), registry, batch=number)
        ledger.compact(spark, registry, REGISTRY)

    return step
