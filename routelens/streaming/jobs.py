"""Structured Streaming forms of ingest, inventory, timeline and anomaly scoring."""

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from routelens.operators import anomaly, traffic as stats
from routelens.operators.inventory import KEY, endpoint_parts
from routelens.plans.analyze import fold_batch, store_traffic
from routelens.plans.behaviour import fold_behaviour
from routelens.plans.shared import materialize
from routelens.sources import logs, tables
from routelens.streaming.tail import tail_lines

# Poll interval of the log watcher.
LOG_INTERVAL = "30 seconds"


def stream_logs(
    spark: SparkSession, folder: str, log_format: str, ingest_time: Column, max_files: int | None = None
) -> DataFrame:
    """Traffic from log files that appear in a folder; the checkpoint remembers finished files."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = logs.clean_lines(reader.load(folder).select(F.col("_metadata.file_path"), "value"))
    return logs.with_pattern(logs.parse_lines(lines, log_format, ingest_time))


def tail_logs(
    spark: SparkSession, paths: str | list[str], log_format: str, ingest_time: Column, start: str = "end", **options
) -> DataFrame:
    """Traffic from the lines that log files get from now on, or from their beginning; see ``streaming.tail``."""
    lines = logs.clean_lines(tail_lines(spark, paths, start, **options))
    return logs.with_pattern(logs.parse_lines(lines, log_format, ingest_time))


def ingest_writer(
    spark: SparkSession, folder: str, path: str, checkpoint: str, ingest_time: Column, once: bool = False, tail: str | None = None
) -> DataStreamWriter:
    """Append the traffic of log files that appear in a folder, each parsed by the format found in its head.

    With ``tail``, ``end`` or ``beginning``, files are followed as they grow, from there on.  A replayed batch replaces what it
    wrote.
    """
    files = spark.readStream.format("text").load(folder).select(F.col("_metadata.file_path"), "value") if tail is None else None
    lines = logs.clean_lines(tail_lines(spark, folder, tail) if tail else files)

    def ingest(batch: DataFrame, batch_id: int) -> None:
        written = materialize(batch, "lines")
        formats = logs.detect_formats(logs.heads_of(written.select("file_path").distinct()))
        traffic = logs.with_pattern(logs.parse_detected(written, formats, ingest_time))
        tables.write_batch(traffic, path, batch_id)

    return _trigger(lines.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint), once)


def _trigger(writer: DataStreamWriter, once: bool) -> DataStreamWriter:
    return writer.trigger(availableNow=True) if once else writer.trigger(processingTime=LOG_INTERVAL)


def inventory_writer(
    traffic: DataFrame, store: str, checkpoint: str, as_of, spec_path: str | None = None, once: bool = False
) -> DataStreamWriter:
    """Fold every micro-batch into the stored inventory, then classify and raise alerts.

    ``as_of`` is called per batch and returns the classification time as a column.  The spec
    table is read again per batch.  A batch that is replayed after a failure reads the state
    before itself and replaces what it wrote, so calls are never counted twice.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark, counted = batch.sparkSession, Observation()
        written = store_traffic(batch, store, batch_id, counted)
        spec = spark.read.parquet(spec_path) if spec_path else None
        report = fold_batch(spark, written, store, as_of(), batch_id, spec)
        progress = report.summary.withColumn("records", F.lit(counted.get["records"]))  # counted while it was written
        tables.write_batch(progress, f"{store}/progress", batch_id)

    return _trigger(traffic.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint), once)


def timeline_writer(
    traffic: DataFrame, path: str, checkpoint: str, bucket_minutes: int = 60, late: str = "1 hour", once: bool = False
) -> DataStreamWriter:
    """Append finished time buckets; a bucket closes when the watermark passes its end.

    Watermarks need zoned times, so wall clocks pass through the session zone here: run streams
    in a UTC session, as ``build_session`` sets up.
    """
    zoned = traffic.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", late)
    buckets = stats.timeline(zoned, bucket_minutes)
    writer = buckets.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")).writeStream.format("parquet").outputMode("append").option("path", path)
    return _trigger(writer.option("checkpointLocation", checkpoint), once)


def scoring_writer(
    traffic: DataFrame,
    profiles: DataFrame,
    store: str,
    checkpoint: str,
    known: DataFrame | None = None,
    once: bool = False,
    **thresholds,
) -> DataStreamWriter:
    """Score every micro-batch against a fixed, written profile table and store its anomalies.

    The state is the activity table, which adds up over batches, so ids and consumers of earlier
    batches count, and those of ``known``, the activity of a training set (phase 0).  A replayed batch
    starts from the state before itself.  Per-source rates and failure shares are those of the batch.  Requests to endpoints without a
    profile are not scored, but count for sources and enumeration.  ``thresholds`` go to ``detect``.
    """
    fixed = profiles.drop("cut", "cut_left")  # the stream begins after all training

    def run(batch: DataFrame, batch_id: int) -> None:
        new = materialize(anomaly.activity(anomaly.observations(batch), fixed), "activity")
        state = new if known is None or batch_id > 0 else anomaly.merge_activity(new, known)
        total = tables.fold_state(f"{store}/activity", state, batch_id, anomaly.merge_activity)
        tables.write_batch(anomaly.detect(total, by_source=new, **thresholds), f"{store}/anomalies", batch_id)

    return _trigger(traffic.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint), once)


def behaviour_writer(traffic: DataFrame, store: str, checkpoint: str, once: bool = False, **options) -> DataStreamWriter:
    """Train on and score every micro-batch; ``plans.behaviour.stored_anomalies`` reads what is found.  ``options`` go to ``fold_behaviour``."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        fold_behaviour(anomaly.observations(batch), store, batch_id, **options)

    return _trigger(traffic.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint), once)


def running_inventory(traffic: DataFrame) -> DataFrame:
    """The inventory state kept by Spark's own state store, for ``update`` or ``complete`` sinks."""
    return endpoint_parts(traffic)


def running_inventory_writer(traffic: DataFrame, path: str, checkpoint: str, once: bool = False) -> DataStreamWriter:
    """Store, per micro-batch, the rows of the inventory state that it changed; ``latest_state`` reads the newest of each."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(batch, path, batch_id)

    writer = running_inventory(traffic).writeStream.outputMode("update").foreachBatch(keep)
    return _trigger(writer.option("checkpointLocation", checkpoint), once)


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The inventory state as the last batch that changed each row left it."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*KEY, "consumer", "batch_id")]
    newest = rows.groupBy(*KEY, "consumer").agg(F.max_by(F.struct(*values), "batch_id").alias("state"))
    return newest.select(*KEY, "consumer", "state.*")
