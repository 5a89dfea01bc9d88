"""ST1: message log ingest as a stream (append sink)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


# Time of the mark that ends an input: all watermarks pass every message.
END_OF_INPUT = "2200-01-01 00:00:00"


def stream_path(sf_dir: str, table: str) -> str:
    """A glob naming one table file, accepted by the file stream source."""
    return f"{sf_dir.rstrip('/')}/{table}.parque[t]"


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(stream_path(sf_dir, "events"))


def as_messages(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("id"), "user_id",
                         F.concat_ws(" ", "event_type", "props").alias("message"),
                         F.col("ts").alias("timestamp"))


def ingest(stream: DataFrame, sink_path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append every message to a Parquet table; exactly-once through the
    checkpoint and the file sink's log."""
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    return w.start(sink_path)


def append_stream(stream: DataFrame, table, checkpoint: str, writer: str, once: bool = True) -> StreamingQuery:
    """Append every micro-batch to a ``KeyedTable`` under its epoch: a batch that
    is sent again after a failure adds nothing."""
    def add(batch: DataFrame, epoch: int) -> None:
        table.append(batch, writer, epoch)

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def until_end(msgs: DataFrame, marks: str) -> DataFrame:
    """``msgs`` (id, user_id, timestamp, ...) and the end-of-input marks written
    under ``marks``. A finite input never moves the watermark past its own last
    messages; the mark does, so that whatever waits for it comes out."""
    spark = msgs.sparkSession
    spark.createDataFrame([], msgs.schema).write.mode("ignore").parquet(marks)
    return msgs.unionByName(spark.readStream.schema(msgs.schema).parquet(marks))


def write_end(spark: SparkSession, schema, marks: str) -> None:
    """Write the end-of-input mark: a row with nothing but its time."""
    empty = spark.range(1).select(*[
        (F.lit(END_OF_INPUT) if f.name == "timestamp" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    empty.write.mode("append").parquet(marks)


def run_to_end(out: DataFrame, sink_path: str, checkpoint: str, schema, marks: str, at_once: bool = False) -> None:
    """Run a query over ``until_end(msgs, marks)`` on all there is, then write
    the mark and run it on to the end.

    ``at_once``: the source has no rate limit, so all there is comes in one
    micro-batch. The mark can come with it, since the watermark moves after a
    micro-batch, and every timer fires once, in the next."""
    if not at_once:
        ingest(out, sink_path, checkpoint).awaitTermination()
    write_end(out.sparkSession, schema, marks)
    ingest(out, sink_path, checkpoint).awaitTermination()
