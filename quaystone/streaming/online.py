"""Structured Streaming: running metrics over result files, and appends that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def results(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet result files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_confusion(stream: DataFrame, expected: str, predicted: str) -> DataFrame:
    """(expected, predicted, n), updated as rows arrive: the state is as large as the label set."""
    return stream.where(F.col(expected).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def windowed_rates(stream: DataFrame, ts: str, flag, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window, n, rate) in event time; rows later than ``late`` are dropped with their state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window")).agg(F.count("*").alias("n"), F.avg(flag.cast("double")).alias("rate"))


def deduplicated(stream: DataFrame, key: str, ts: str, late: str = "7 days") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def append(stream: DataFrame, transform, path: str, checkpoint: str):
    """Runs ``transform`` on each micro-batch and appends it; a batch that was written is not written again."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_memory(out: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its last result."""
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return out.sparkSession.table(name)
