"""The batch jobs a user runs end to end."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routelens.functions.paths import endpoint_id, non_empty
from routelens.operators import alerts, inventory
from routelens.schemas import ENDPOINT_PARTS, ENDPOINTS
from routelens.sources import logs, tables
from routelens.sources.state import KEEP, Files, Manifest, PartedTable, bucket_of, parts_in

#: Parts of the stored inventory.  More make a batch that touches few endpoints cheaper.
BUCKETS = 32
#: Stored endpoints with the kinds of alerts that they have raised so far, and raised first in the last batch that touched them.
_STORED = T.StructType([*ENDPOINTS.fields, T.StructField("raised", T.ArrayType(T.StringType())), T.StructField("newly", T.ArrayType(T.StringType()))])
_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class InventoryReport:
    summary: DataFrame
    endpoints: DataFrame
    alerts: DataFrame


def inventory_report(
    parts: DataFrame, as_of: Column, spec: DataFrame | None = None, zombie_days: int = inventory.ZOMBIE_DAYS
) -> InventoryReport:
    """State -> classified endpoints, alerts and summary."""
    endpoints = inventory.endpoints_from_parts(parts)
    if spec is not None:
        endpoints = inventory.correlate_spec(endpoints, spec)
    endpoints = inventory.classify(endpoints, as_of, zombie_days)
    return InventoryReport(
        inventory.report(endpoints, as_of), endpoints, alerts.generate_alerts(endpoints, as_of)
    )


def analyze_logs(
    spark: SparkSession,
    paths: str | list[str],
    store: str,
    as_of: Column,
    batch_id: int,
    log_format: str = "auto",
    spec: DataFrame | None = None,
) -> InventoryReport:
    """Ingest log files into the store at ``store`` and return the updated report.

    ``batch_id`` names the batch: running the same batch again replaces it instead of counting
    its calls twice, and an older one renews what later batches made of it, see ``fold_batch``.
    """
    traffic = logs.with_pattern(logs.read_logs(spark, paths, as_of, log_format))
    written = store_traffic(traffic, store, batch_id)
    return fold_batch(spark, written, store, as_of, batch_id, spec)


def store_traffic(traffic: DataFrame, store: str, batch_id: int, observed: Observation | None = None) -> DataFrame:
    """Write a batch of traffic by day and continue from what was written.  ``observed`` gets the number of ``records``."""
    rows = traffic.drop("raw_line", "file_path").withColumn("dt", F.col("timestamp").cast("date"))
    counted = rows if observed is None else rows.observe(observed, F.count("*").alias("records"))
    tables.write_batch(counted, f"{store}/traffic", batch_id, "dt")
    return traffic.sparkSession.read.schema(rows.schema).parquet(f"{store}/traffic/batch_id={batch_id}")


def _tables(spark: SparkSession, store: str) -> tuple[PartedTable, PartedTable]:
    return PartedTable(spark, f"{store}/parts", "bucket", ENDPOINT_PARTS), PartedTable(spark, f"{store}/endpoints", "bucket", _STORED)


def _bucket(buckets: int) -> Column:
    return bucket_of([endpoint_id(F.col("method"), F.col("host"), F.col("path_pattern"))], buckets)


def stored_endpoints(spark: SparkSession, store: str) -> DataFrame:
    """The endpoints as the last batch left them."""
    _, table = _tables(spark, store)
    return table.read(table.manifest()).select(*ENDPOINTS.fieldNames())


def fold_batch(
    spark: SparkSession, traffic: DataFrame, store: str, as_of: Column, batch_id: int, spec: DataFrame | None = None,
    buckets: int = BUCKETS, keep: int = KEEP,
) -> InventoryReport:
    """Merge one batch of traffic into the stored state and refresh endpoints and alerts.

    State and endpoints are cut into ``buckets`` by endpoint, and only buckets are read and written that hold an endpoint of the
    batch, whose routes in the spec changed, or in which the passing of time changes an endpoint by now; manifests tell.
    An alert is stored in the batch that raises it first.

    A batch that runs again starts from the state before itself, and then the buckets it touches are renewed in the batches after
    it.  That takes the state before it: of more than ``keep`` batches ago it is gone, which is an error.
    """
    parts, endpoints = _tables(spark, store)
    known, facts = endpoints.versions(), endpoints.manifest().facts
    first, buckets = facts.get("first", batch_id), facts.get("buckets", buckets)  # a store keeps its buckets
    if batch_id > first and batch_id <= known[0]:
        raise ValueError(f"batch {batch_id} is part of the snapshot of batch {known[0]}; replay from a copy of the older state")
    again = endpoints.manifest_of(batch_id) if batch_id in known else Manifest()
    touched = {p for p, x in again.parts.items() if _made_in(x, batch_id)}

    bucket = _bucket(buckets)
    delta = inventory.endpoint_parts(traffic).withColumn("bucket", bucket).repartition("bucket")
    delta.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/deltas/{batch_id}")
    files = Files(spark, store)
    touched |= parts_in(files, f"{store}/deltas/{batch_id}", "bucket")
    now = spark.sql("SELECT 1 AS one").select(F.date_format(as_of, _TIME)).first()[0]
    facts = {"first": min(first, batch_id), "as_of": now, "buckets": buckets}
    touched = _fold(spark, store, batch_id, touched, facts, spec, keep, renewed=False)
    for later in [v for v in known if v > batch_id]:
        _fold(spark, store, later, touched, endpoints.manifest_of(later).facts, None, keep, renewed=True)
    for old in [v for v in files.names(f"{store}/deltas") if v.isdigit() and int(v) < endpoints.versions()[0]]:
        files.delete(f"{store}/deltas/{old}")

    manifest = endpoints.manifest()
    current = endpoints.read(manifest).select(*ENDPOINTS.fieldNames())
    names = inventory.report(current, as_of).columns
    counts = [sum(x[c] for x in manifest.parts.values()) for c in names]
    summary = spark.createDataFrame([counts], ", ".join(f"{c} bigint" for c in names))
    return InventoryReport(summary, current, alerts.generate_alerts(current, as_of))


def _made_in(part: dict, version: int) -> bool:
    return part["run"].startswith(f"{version}-")


def _fold(
    spark: SparkSession, store: str, version: int, touched: set[str], facts: dict, spec: DataFrame | None, keep: int, renewed: bool
) -> set[str]:
    """Make a version of the touched buckets from the one before and the version's traffic; returns the buckets it wrote."""
    parts, endpoints = _tables(spark, store)
    as_of = F.lit(facts["as_of"]).cast("timestamp_ntz")
    bucket = _bucket(facts["buckets"])
    before_parts, before = parts.manifest(before=version), endpoints.manifest(before=version)
    old = endpoints.manifest_of(version) if renewed else None
    routes, digests = None, before.facts.get("spec", {})
    if spec is not None:
        routes = spec.select("method", F.col("path").alias("path_pattern"), non_empty(F.col("host")).alias("host"), "deprecated").withColumn("bucket", bucket)
        sums = routes.groupBy("bucket").agg(F.sum(F.xxhash64("method", "path_pattern", "host", "deprecated").cast("decimal(38,0)")).cast("string").alias("sum"))
        digests = {str(r["bucket"]): r["sum"] for r in sums.collect()}  # a row per bucket
        touched = touched | {b for b, x in digests.items() if x != before.facts.get("spec", {}).get(b)}
    if not renewed:
        touched = touched | {b for b, x in before.parts.items() if x["due"] and x["due"] <= facts["as_of"]}

    own, run = parts_in(parts.files, f"{store}/deltas/{version}", "bucket") & touched, None
    if own:
        paths = [f"{store}/deltas/{version}/bucket={b}" for b in sorted(own)]
        delta = spark.read.schema(ENDPOINT_PARTS).parquet(*paths)
        merged = inventory.merge_parts(parts.read(before_parts, sorted(own)), delta).withColumn("bucket", bucket)
        run, own = parts.write(merged.repartition("bucket"), version)
    untouched = (parts.manifest_of(version) if renewed else before_parts).parts
    entries = {b: x for b, x in untouched.items() if b not in touched} | {b: x for b, x in before_parts.parts.items() if b in touched}
    after_parts = Manifest(version, entries | {b: {"run": run} for b in own})
    parts.commit(after_parts, keep)

    wanted = sorted(touched)
    stored = endpoints.read(before, wanted)
    declared = stored.filter("declared_in_spec")  # what an earlier spec declared or deprecated stays so
    if old is not None:
        declared = declared.unionByName(endpoints.read(old, wanted).filter("declared_in_spec"))
    declared = declared.select("method", F.col("path_pattern").alias("path"), "host", (F.col("status") == "deprecated").alias("deprecated"))
    if routes is not None:
        mine = routes.filter(F.col("bucket").isin([int(b) for b in wanted])).drop("bucket")
        declared = declared.unionByName(mine.withColumnRenamed("path_pattern", "path"))
    fresh = inventory_report(parts.read(after_parts, wanted), as_of, declared).endpoints
    merged = inventory.upsert_endpoints(stored.select(*ENDPOINTS.fieldNames()), fresh)
    seen = stored.select("endpoint_id", F.col("raised").alias("_seen"))
    none = F.array().cast("array<string>")
    rows = merged.join(seen, "endpoint_id", "left").withColumn("_kinds", alerts.alert_kinds(as_of))
    rows = rows.withColumn("raised", F.array_union(F.coalesce("_seen", none), "_kinds")).withColumn("newly", F.array_except("_kinds", F.coalesce("_seen", none)))
    run, made = endpoints.write(rows.drop("_seen", "_kinds").withColumn("bucket", bucket).repartition("bucket"), version)

    written = endpoints.read(Manifest(version, {b: {"run": run} for b in made}))
    due = F.date_format(F.min(inventory.changes_at(as_of)), _TIME).alias("due")
    sums = written.groupBy(bucket.alias("bucket")).agg(*inventory.report_counts(as_of), due).collect()  # a row per bucket
    entries = {str(r["bucket"]): {"run": run} | {k: v for k, v in r.asDict().items() if k != "bucket"} for r in sums}
    base = old.parts if old is not None else before.parts
    endpoints.commit(Manifest(version, {b: x for b, x in base.items() if b not in touched} | entries, facts | {"spec": digests}), keep)

    new = alerts.generate_alerts(written.filter("size(newly) > 0"), as_of)
    new = new.join(written.select("endpoint_id", "newly"), "endpoint_id").filter(F.expr("array_contains(newly, alert_type)")).drop("newly")
    if old is not None:  # what buckets that this run does not touch raised then
        stay = [b for b, x in old.parts.items() if _made_in(x, version) and b not in touched]
        rest = endpoints.read(old, stay)
        more = alerts.generate_alerts(rest, as_of).join(rest.select("endpoint_id", "newly"), "endpoint_id")
        new = new.unionByName(more.filter(F.expr("array_contains(newly, alert_type)")).drop("newly"))
    tables.write_batch(new, f"{store}/alerts", version)
    return touched
