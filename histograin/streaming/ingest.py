"""Histories and event tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Config
from ..plans.store import Store, ingest
from ..sources.git import GitHistory


def follow(spark: SparkSession, store: Store, repo: str, config: Config, checkpoint: str):
    """Start a query that takes in all commits not seen yet and ends; its offset is the repository's head, and a batch that is run again adds nothing twice."""
    spark.dataSource.register(GitHistory)
    stream = spark.readStream.format("git_history").option("path", repo).load()

    def take(batch: DataFrame, _number: int) -> None:
        tip = batch.where("walk_index = 0").select("sha").first()  # the batch's end; the repository may be further by now
        if tip:
            ingest(store, batch, config, tip.sha)
            store.vacuum()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream with a time column that watermarks take."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    own = spark.readStream.schema(table.schema)
    if any(f.endswith("/events.parquet") for f in table.inputFiles()):  # a table of one file: streams read folders
        stream = own.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = own.parquet(f"{sf_dir}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def available_now(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what there is now into Parquet."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def windowed(stream: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, sliding ones if ``slide`` is given."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events of each user in sessions that a gap ends."""
    own = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return own.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
