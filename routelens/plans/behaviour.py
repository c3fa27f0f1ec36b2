"""Online behaviour analysis: train per endpoint, then score, batch by batch.

The state is four tables cut into buckets, see ``sources.state``.  ``pending`` holds the records of endpoints whose training
window is not full, fewer than a window each; ``profiles`` the others' profiles; ``activity`` one row per (endpoint, source,
resource id), by pair, so distinct ids and first records of earlier batches count; ``sources`` the totals per source.  A batch
opens the buckets that its endpoints, pairs and sources fall into, and finds the anomalies of these buckets anew.

Batches in order of time give, together, what ``anomaly.detect`` gives over all records at once.  A record that arrives later than
the batch in which its endpoint's window filled is scored, though it is older than some that trained.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from routelens.operators import anomaly
from routelens.plans.shared import materialize
from routelens.sources.state import KEEP, Manifest, PartedTable, bucket_of

BUCKETS = 32
_RECORD = "method string, path_pattern string, source string, resource_id string, status_code int, latency double, phase int, timestamp timestamp_ntz, record_id bigint, seq decimal(38,0)"
_PROFILE = "method string, path_pattern string, sample_count bigint, avg_latency double, std_latency double, cut decimal(38,0), cut_left boolean, is_trained boolean"
_ACTIVITY = (
    "method string, path_pattern string, source string, resource_id string, requests bigint, auth_failures bigint, first_at timestamp_ntz, last_at timestamp_ntz, "
    "first_seq decimal(38,0), first_time timestamp_ntz, first_scored decimal(38,0), scored_time timestamp_ntz, outlier_seq decimal(38,0), "
    "outlier_time timestamp_ntz, outlier_latency double, avg_latency double, std_latency double"
)
_SOURCE = "source string, requests bigint, auth_failures bigint, first_at timestamp_ntz, last_at timestamp_ntz"
_FOUND = "anomaly_type string, severity string, endpoint string, source string, message string, score double, timestamp timestamp_ntz, details map<string,string>"
_TABLES = {
    "pending": (_RECORD, anomaly.ENDPOINT), "profiles": (_PROFILE, anomaly.ENDPOINT), "activity": (_ACTIVITY, anomaly.PAIR),
    "pair-anomalies": (_FOUND, None), "sources": (_SOURCE, ["source"]), "source-anomalies": (_FOUND, None),
}


def _table(spark: SparkSession, store: str, name: str) -> PartedTable:
    return PartedTable(spark, f"{store}/{name}", "bucket", StructType.fromDDL(_TABLES[name][0]))


def _bucket(name: str, buckets: int) -> Column:
    return bucket_of([F.col(c) for c in _TABLES[name][1]], buckets)


def _replace(table: PartedTable, rows: DataFrame, before: Manifest, touched: set[str], version: int, keep: int) -> DataFrame:
    """Put ``rows``, with their bucket, in the place of the touched buckets; returns what was written."""
    run, made = table.write(rows.select(*table.schema.fieldNames(), "bucket").repartition("bucket"), version)
    parts = {b: x for b, x in before.parts.items() if b not in touched}
    table.commit(Manifest(version, parts | {b: {"run": run} for b in made}), keep)
    return table.read(Manifest(version, {b: {"run": run} for b in made}))


def _touched(rows: DataFrame, bucket: Column) -> set[str]:
    return {str(r[0]) for r in rows.select(bucket.alias("bucket")).distinct().collect()}  # a row per bucket


def fold_behaviour(
    rows: DataFrame, store: str, batch_id: int, training_window: int = anomaly.TRAINING_WINDOW, bola_threshold: int = anomaly.BOLA_IDS,
    medium_rpm: float = anomaly.RATE_MEDIUM_RPM, high_rpm: float = anomaly.RATE_HIGH_RPM, buckets: int = BUCKETS, keep: int = KEEP,
) -> None:
    """Train on and score the records of one batch (``anomaly.observations``), and renew the anomalies that they can change.

    A batch that runs again starts from the state before itself; one that is not the newest cannot run again.
    """
    spark = rows.sparkSession
    tables = {name: _table(spark, store, name) for name in _TABLES}
    newest = tables["pending"].manifest().version
    if newest > batch_id:
        raise ValueError(f"batch {batch_id} cannot run again after batch {newest}")
    before = {name: table.manifest(before=batch_id) for name, table in tables.items()}
    batch = materialize(rows.select(*tables["pending"].schema.fieldNames()), "records")

    by_endpoint = _bucket("pending", buckets)
    touched = _touched(batch, by_endpoint)
    known = tables["profiles"].read(before["profiles"], sorted(touched))
    pending = tables["pending"].read(before["pending"], sorted(touched))
    untrained = pending.unionByName(batch.join(known.select(*anomaly.ENDPOINT), anomaly.ENDPOINT, "left_anti"))
    untrained = materialize(untrained, "untrained")
    tried = materialize(anomaly.train_then_detect(untrained, training_window).select(*tables["profiles"].schema.fieldNames()), "tried-profiles")
    trained = tried.filter("is_trained")
    waiting = untrained.join(trained.select(*anomaly.ENDPOINT), anomaly.ENDPOINT, "left_anti")
    _replace(tables["profiles"], known.unionByName(trained).withColumn("bucket", by_endpoint), before["profiles"], touched, batch_id, keep)

    # Earlier records of an endpoint trained now are all before its cut; nothing of known profiles is left to train.
    profiles = materialize(known.withColumns({"cut": F.lit(None).cast("decimal(38,0)"), "cut_left": F.lit(False)}).unionByName(tried), "profiles")
    new = materialize(anomaly.activity(batch, profiles), "activity")
    by_pair = _bucket("activity", buckets)
    pairs = _touched(new, by_pair)
    total = anomaly.merge_activity(tables["activity"].read(before["activity"], sorted(pairs)), new)
    total = _replace(tables["activity"], total.withColumn("bucket", by_pair), before["activity"], pairs, batch_id, keep)
    found = anomaly.pair_anomalies(total, bola_threshold)
    method, path = F.substring_index("endpoint", " ", 1), F.expr("substring(endpoint, instr(endpoint, ' ') + 1)")
    of_pair = bucket_of([method, path, F.col("source")], buckets)
    _replace(tables["pair-anomalies"], found.withColumn("bucket", of_pair), before["pair-anomalies"], pairs, batch_id, keep)

    by_source = _bucket("sources", buckets)
    sources = _touched(new, by_source)
    sums = tables["sources"].read(before["sources"], sorted(sources)).unionByName(new.select(*tables["sources"].schema.fieldNames()))
    sums = sums.groupBy("source").agg(
        F.sum("requests").alias("requests"), F.sum("auth_failures").alias("auth_failures"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )
    sums = _replace(tables["sources"], sums.withColumn("bucket", by_source), before["sources"], sources, batch_id, keep)
    found = anomaly.source_anomalies(sums, medium_rpm, high_rpm)
    _replace(tables["source-anomalies"], found.withColumn("bucket", by_source), before["source-anomalies"], sources, batch_id, keep)
    _replace(tables["pending"], waiting.withColumn("bucket", by_endpoint), before["pending"], touched, batch_id, keep)  # last: it says what ran


def stored_anomalies(spark: SparkSession, store: str) -> DataFrame:
    """All anomalies as the last batch left them."""
    tables = [_table(spark, store, name) for name in ("pair-anomalies", "source-anomalies")]
    return tables[0].read(tables[0].manifest()).unionByName(tables[1].read(tables[1].manifest()))
