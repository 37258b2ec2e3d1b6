"""Structured Streaming forms (ST1-ST3, H4).

The same DataFrame operators run on streams: a file stream of JSON
document messages is chunked and enriched per micro-batch and appended
through the exactly-once file sink; duplicate chunks are dropped within a
watermark; query-log metrics are windowed aggregates with a watermark.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..operators import chunking, enrich

MESSAGE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType())])


def document_stream(spark: SparkSession, path: str, schema: T.StructType = MESSAGE_SCHEMA,
                    max_files: int | None = None) -> DataFrame:
    """ST1 source: JSON document messages dropped into ``path``."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


def process_documents(stream: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """ST1 body: the batch chunk + enrich plan applied to a stream."""
    ch = chunking.chunk_window(stream, size=size, overlap=overlap, keep=("lang", "source", "published_at"))
    return enrich.enrich_chunks(ch, document_type="lang", facility="source")


def dedup_stream(chunks: DataFrame, ts: str = "published_at", delay: str = "1 hour",
                 key: str = "chunk_hash") -> DataFrame:
    """ST2: drop chunks whose hash was already seen within the watermark
    (state is bounded by the watermark; later duplicates pass). Rows older than the
    watermark are dropped by the engine; ``run_dedup`` keeps them in a table."""
    return chunks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) \
                 .dropDuplicatesWithinWatermark([key])


def _or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def run_dedup(chunks: DataFrame, folder: str, ts: str = "published_at", delay: str = "1 hour",
              key: str = "chunk_hash"):
    """ST2 run that accounts for late rows; processes what is available, then stops.

    Tables under ``folder`` (shared storage), one part a micro-batch, which a repeated
    batch overwrites: ``kept`` has the first row of each key, ``late`` all rows older than
    the watermark when their batch began, ``marks`` the watermark behind each batch (the
    latest time seen less ``delay``) and the rows seen, kept, late and repeated. A key is
    remembered while the watermark has not passed its time, as in ``dedup_stream``: of the
    kept parts only those are read that reach behind it. Rows without a time are late.
    """
    spark = chunks.sparkSession
    schema = T.StructType(chunks.schema.fields)
    counts = "mark timestamp_ntz, latest timestamp_ntz, seen long, kept long, late long, repeated long, batch long"

    def batch(rows: DataFrame, number: int) -> None:
        marks = _or_empty(spark, f"{folder}/marks", counts).where(F.col("batch") < number)
        mark = marks.agg(F.max("mark")).first()[0]
        rows = rows.withColumn(ts, F.col(ts).cast("timestamp_ntz")).persist()
        on_time = F.lit(True) if mark is None else F.col(ts) >= F.lit(mark)
        on_time = F.coalesce(on_time & F.col(ts).isNotNull(), F.lit(False))
        rows.where(~on_time).write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        before = _or_empty(spark, f"{folder}/kept", T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())]))
        alive = [r["batch"] for r in marks.where(F.lit(True) if mark is None else F.col("latest") >= F.lit(mark))
                 .select("batch").toLocalIterator()]
        known = before.where(F.col("batch").isin(alive)) if alive else before.limit(0)
        if mark is not None:
            known = known.where(F.col(ts) >= F.lit(mark))
        one = rows.where(on_time).groupBy(F.col(key).alias("_k")).agg(
            F.min_by(F.struct(*rows.columns), F.struct(ts, F.xxhash64(*rows.columns))).alias("r")).select("r.*")
        fresh = one.join(known.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")
        kept = spark.read.schema(rows.schema).parquet(f"{folder}/kept/batch={number}").count()
        size = rows.agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(~on_time, 1)).alias("late"),
                        F.max(ts).alias("latest"))
        latest = F.col("latest") - F.expr(f"INTERVAL {delay}")
        (size.select(F.greatest(latest, F.lit(mark).cast("timestamp_ntz")).alias("mark"), "latest", "seen",
                     F.lit(kept).cast("long").alias("kept"), "late", (F.col("seen") - F.col("late") - kept).alias("repeated"))
         .coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}"))
        rows.unpersist()

    q = (chunks.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    kept, late = (spark.read.schema(schema).parquet(f"{folder}/{x}") for x in ("kept", "late"))
    return kept, late, spark.read.schema(counts).parquet(f"{folder}/marks")


def query_metrics(log: DataFrame, ts: str = "ts", window: str = "1 hour", delay: str = "10 minutes",
                  ms: str = "value", kind: str = "event_type") -> DataFrame:
    """ST3: per window count, mean/max latency and error rate, with alert
    flags (latency > 2000 ms, error rate > 5 %). Works on a batch or a
    stream (the watermark is ignored in batch)."""
    if log.isStreaming:                       # watermarks need TIMESTAMP; batch stays zone-free
        log = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    agg = log.groupBy(F.window(ts, window).alias("w")).agg(
        F.count(F.lit(1)).alias("queries"), F.avg(ms).alias("avg_ms"), F.max(ms).alias("max_ms"),
        F.avg((F.col(kind) == "error").cast("double")).alias("error_rate"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "queries", "avg_ms", "max_ms", "error_rate",
                      (F.col("max_ms") > L.LATENCY_MAX_MS).alias("latency_alert"),
                      (F.col("error_rate") > 0.05).alias("error_alert"))


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      output_mode: str = "append"):
    """H4: process everything available now, exactly once (the file sink
    plus the checkpoint make a retried batch idempotent), then stop."""
    q = (df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink_path))
    q.awaitTermination()
    return q


def run_complete(df: DataFrame, sink_path: str, checkpoint: str):
    """ST3 run: process everything available now and keep the whole windowed
    result as a table. A batch overwrites the table of the one before, so a
    repeated batch changes nothing."""
    q = (df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
         .foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(sink_path))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
