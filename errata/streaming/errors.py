"""Structured Streaming wiring of the stateless row-wise jobs.

Error classification (F6) is a pure projection, so the same expression runs
on a stream of execution-error logs: file source -> classify -> parquet sink,
with the checkpoint under the shared checkpoint folder so a restarted query
resumes exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from errata.operators.detect import classify_errors
from errata.session import scratch_path

LOG_SCHEMA = "log_id bigint, example_id bigint, message string"


def classify_error_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                          available_now: bool = True):
    """Start the streaming classification of JSON error logs in
    ``source_dir``; returns the StreamingQuery."""
    stream = spark.readStream.schema(LOG_SCHEMA).json(source_dir)
    out = classify_errors(stream)
    w = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_once(spark: SparkSession, logs: DataFrame) -> DataFrame:
    """Write ``logs`` as the stream's input, drain the stream once and return
    the classified rows read back from the sink."""
    src = scratch_path(spark, "error-log-src")
    logs.write.mode("overwrite").json(src)
    sink, ckpt = scratch_path(spark, "error-log-sink"), scratch_path(spark, "error-log-ckpt")
    q = classify_error_stream(spark, src, sink, ckpt)
    q.awaitTermination()
    return spark.read.parquet(sink)
