"""Streaming forms of two batch operations; an extension, since batch files are all the pipeline needs.

Both run with ``availableNow`` over files that arrive and keep their place in a
checkpoint folder, so a run that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.functions.text import is_error, present


def windowed_rates(events: DataFrame, time: str, by: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, by, n, mean) in event time; rows later than the watermark are dropped, state is bounded by it."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), by)
    rates = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return rates.select(F.col("window.start").alias("start"), by, "n", "mean")


def resume_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, answer: str, redo: Callable[[DataFrame], DataFrame]) -> None:
    """Take new files of answers, do rows without a usable one again and append usable rows to ``target``.

    A batch that is replayed after a failure writes its own folder again, so
    every row is there once.
    """

    def step(batch: DataFrame, number: int) -> None:
        usable = present(answer).isNotNull() & ~is_error(answer)
        again = redo(batch.filter(~usable).drop(answer)).select(*batch.columns)
        rows = batch.filter(usable).unionByName(again).dropDuplicates([key])
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).json(source)
    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
