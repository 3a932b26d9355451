"""Incremental ingest: a stream of files or texts into the store, batch by batch; and windowed counts of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmere.engine import Engine
from quillmere.operators.lineage import place
from quillmere.sources import files as sources


def file_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """(path, content, content_hash, format) of files as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    return sources.hashed(raw)


def ingest_stream(engine: Engine, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Every batch of files goes through the engine's own ingest. A batch that is run again after a failure finds its files' hashes and skips them."""

    def upsert(batch: DataFrame, number: int) -> None:
        # one file may come twice in a batch; the last content counts
        one = batch.groupBy("path").agg(F.max_by(F.struct("content", "content_hash", "format"), "content_hash").alias("x")).select("path", "x.*")
        engine.ingest_files(one).write.format("noop").mode("overwrite").save()

    writer = file_stream(engine.spark, folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def distinct_texts(stream: DataFrame, text: str = "text", time: str = "ts", delay: str = "1 day") -> DataFrame:
    """A stream without texts that came before within the watermark."""
    return stream.withColumn("content_hash", F.sha2(text, 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) by tumbling window; rows later than the watermark are left out of a stream."""
    timed = events.withWatermark(time, delay) if events.isStreaming else events
    made = timed.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return made.select(F.col("window.start").alias("start"), kind, "n", "total")


def closed_windows(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """``windowed_counts`` of files of a folder as a stream that is read to its end; the windows that the watermark has closed, from a table in the shared folder."""
    # a watermark needs a point in time, not a date and time without zone
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    home = place(spark, "windows")
    made = windowed_counts(events)
    query = made.writeStream.format("parquet").option("path", f"{home}/rows").option("checkpointLocation", f"{home}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{home}/rows")
