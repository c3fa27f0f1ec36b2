"""L: the same operators as streams over files that arrive in steps."""

from pyspark.sql import functions as F

from routelens.operators import anomaly
from routelens.plans.analyze import store_traffic, stored_endpoints
from routelens.plans.layout import compact_traffic, read_traffic
from routelens.plans.shared import materialize, scratch_path
from routelens.streaming import jobs
from routelens.plans.behaviour import stored_anomalies
from workload import views
from workload.q_anomaly import ANOMALIES_SQL
from workload.q_inventory import _ENDPOINT, _endpoint_columns
from workload.q_sources import _expected, _parsed
from workload.q_traffic import HOURLY
from workload.registry import query, r6, text
from workload.sql import WINDOW, alerts as alerts_sql, classified as classified_sql


def _run(writer) -> None:
    writer.start().awaitTermination()


def _store(spark, d, spec: bool = False) -> str:
    """Run the inventory stream over all arriving files and return its store."""
    store, state = scratch_path(spark, "store"), scratch_path(spark, "stream-state")
    spec_path = None
    if spec:
        spec_path = scratch_path(spark, "spec")
        views.spec_rows(spark, d).write.parquet(spec_path)
    _run(jobs.inventory_writer(views.traffic_stream(spark, d), store, state, views.as_of, spec_path, once=True))
    return store


def _endpoints(spark, store):
    return stored_endpoints(spark, store)


@query("l1_micro_batch_inventory", f"SELECT {_ENDPOINT}, status FROM plainep")
def _(spark, d):
    return _endpoints(spark, _store(spark, d)).select(*_endpoint_columns(), "status")


@query(
    "l2_tail_new_files",
    "SELECT method, path, count(*) AS calls FROM (SELECT method, path FROM gtext UNION ALL SELECT method, path FROM gtext) GROUP BY method, path",
)
def _(spark, d):
    # a second set of files arrives after the first run; the checkpoint skips what is done
    folder = views.log_files(spark, d, "generic")[0]
    out, state = scratch_path(spark, "tail"), scratch_path(spark, "tail-state")
    for _step in range(2):
        stream = jobs.stream_logs(spark, folder, "generic", views.as_of())
        _run(
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True)
        )
        if _step == 0:
            views.generic_text_lines(spark, d).select("raw_line").write.mode("append").text(folder)
    return spark.read.parquet(out).groupBy("method", "path").agg(F.count("*").alias("calls"))


@query(
    "l2_tail_growing_files",
    "SELECT method, path, count(*) + count(*) FILTER (k % 2 = 0) AS calls FROM ln GROUP BY method, path",
)
def _(spark, d):
    # Files grow in three steps, of which the first two end in the middle of a line; then shorter ones, of the lines of one
    # kind, take their places.  The stream stops after each step and goes on from its checkpoint.
    folder, out, state = (scratch_path(spark, x) for x in ("growing", "followed", "follow-state"))
    lines = views.followed_lines(spark, d)
    steps = lines.withColumn("seq", F.pmod(F.shiftright("seq", 3), F.lit(3)) * 2**60 + F.col("seq"))

    def follow():
        stream = jobs.tail_logs(spark, folder, "generic", views.as_of(), start="beginning", range_bytes=1 << 16)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        _run(writer.trigger(availableNow=True))

    for step in range(3):
        done = F.col("seq") < (step + 1) * 2**60
        views.write_log_files(steps.filter(done), folder, steps.filter(~done) if step < 2 else None)
        follow()
    views.write_log_files(lines.filter("raw_line LIKE 'app[1]: %'"), folder)
    follow()
    return spark.read.parquet(out).groupBy("method", "path").agg(F.count("*").alias("calls"))


@query("l2_tail_detects_formats", f"{_expected('nginx')} UNION ALL {_expected('gtext')}")
def _(spark, d):
    # files of two formats arrive in one folder
    out, state, folder = (scratch_path(spark, x) for x in ("detected", "detected-state", "mixed-logs"))
    for lines in (views.nginx_lines(spark, d), views.generic_text_lines(spark, d)):
        lines.select("raw_line").write.mode("append").text(folder)
        _run(jobs.ingest_writer(spark, folder, out, state, views.as_of(), once=True))
    return _parsed(spark.read.parquet(out))


@query(
    "l3_stateful_inventory",
    "SELECT method, host, path_pattern, coalesce(auth_subject, source_ip, source_service) AS consumer, count(*) AS calls FROM traffic GROUP BY ALL",
)
def _(spark, d):
    out, state = scratch_path(spark, "running"), scratch_path(spark, "stream-state")
    _run(jobs.running_inventory_writer(views.traffic_stream(spark, d), out, state, once=True))
    return jobs.latest_state(spark, out).select("method", "host", "path_pattern", "consumer", "calls")


@query("l4_state_recovery", "SELECT endpoint_id, total_calls, error_count, consumer_count FROM inv")
def _(spark, d):
    # the stream stops after the first files and starts again from its checkpoint and snapshot
    folder, store, state = scratch_path(spark, "arriving"), scratch_path(spark, "store"), scratch_path(spark, "stream-state")
    rows, cut = views.raw_traffic(spark, d), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    for part in (F.col("timestamp") < cut, F.col("timestamp") >= cut):
        rows.filter(part).write.mode("append").parquet(folder)
        stream = views.traffic_stream(spark, d, folder)
        _run(jobs.inventory_writer(stream, store, state, views.as_of, once=True))
    return _endpoints(spark, store).select("endpoint_id", "total_calls", "error_count", "consumer_count")


@query(
    "l5_alerts_per_cycle",
    f"""SELECT endpoint_id, alert_type, severity FROM ({alerts_sql(f"({classified_sql("SELECT *, 'undocumented' AS st, false AS declared FROM half1")})")})
    UNION SELECT endpoint_id, alert_type, severity FROM ({alerts_sql('plainep')})""",
)
def _(spark, d):
    # an alert is stored in the cycle that raises it first
    return spark.read.parquet(f"{_store(spark, d)}/alerts").select("endpoint_id", "alert_type", "severity")


@query("l6_spec_correlation", "SELECT endpoint_id, status, declared AS declared_in_spec, total_calls FROM ep")
def _(spark, d):
    rows = _endpoints(spark, _store(spark, d, spec=True))
    return rows.select("endpoint_id", "status", "declared_in_spec", "total_calls")


_SECOND, _THIRD, _FIXED_WINDOW = "2024-01-11 00:00:00", "2024-01-21 00:00:00", 30
_RATES = (0.001, 0.02)  # a month of sparse traffic
_L7 = f"""/*with*/ told AS (SELECT * FROM obs WHERE tm < TIMESTAMP '{_SECOND}' AND path_pattern <> '/internal/metrics'),
    fresh AS (SELECT *, CASE WHEN tm < TIMESTAMP '{_THIRD}' THEN 0 ELSE 1 END AS batch FROM obs WHERE tm >= TIMESTAMP '{_SECOND}'),
    fixed AS (SELECT endpoint, avg(latency) AS mean, stddev_pop(latency) AS dev FROM told GROUP BY endpoint HAVING count(*) >= {_FIXED_WINDOW}),
    everything AS (SELECT *, -1 AS batch FROM told UNION ALL SELECT * FROM fresh),
    ids AS (SELECT endpoint, source, rid, min(batch) AS first_batch FROM everything WHERE rid IS NOT NULL GROUP BY ALL),
    steps AS (SELECT *, num - lag(num) OVER (PARTITION BY upto, endpoint, source ORDER BY num) AS gap FROM (
        SELECT DISTINCT b.upto, endpoint, source, rid, CAST(rid AS BIGINT) AS num FROM ids, (VALUES (0), (1)) b(upto)
        WHERE first_batch <= b.upto AND regexp_full_match(rid, '[0-9]+'))),
    persource AS (SELECT batch, source, count(*) AS n, count(*) FILTER (status_code IN (401, 403)) AS failed,
        epoch_us(max(tm)) - epoch_us(min(tm)) AS us FROM fresh GROUP BY batch, source),
    touched AS (SELECT DISTINCT b.upto, endpoint, source FROM fresh, (VALUES (0), (1)) b(upto) WHERE batch <= b.upto AND regexp_full_match(rid, '[0-9]+')) /*end*/
    SELECT DISTINCT anomaly_type, endpoint, source FROM (
    SELECT 'data_exfiltration' AS anomaly_type, endpoint, source FROM fresh JOIN fixed USING (endpoint)
        WHERE dev > 0 AND latency > mean AND abs(latency - mean) / dev > 3
    UNION ALL SELECT 'bola', endpoint, source FROM (SELECT endpoint, source, count(*) AS n FROM ids JOIN fixed USING (endpoint) GROUP BY ALL) b WHERE n > 20
        AND EXISTS (SELECT 1 FROM fresh f WHERE f.endpoint = b.endpoint AND f.source = b.source AND f.rid IS NOT NULL)
    UNION ALL SELECT 'new_consumer', f.endpoint, f.source FROM fresh f JOIN fixed USING (endpoint)
        WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.endpoint = f.endpoint AND t.source = f.source)
    UNION ALL SELECT 'credential_stuffing', 'multiple', source FROM persource WHERE n >= 10 AND failed / n > 0.8
    UNION ALL SELECT 'rate_anomaly', 'multiple', source FROM persource WHERE n >= 5 AND us > 0 AND n / (us / 1000000.0 / 60) > {_RATES[0]}
    UNION ALL SELECT 'enumeration', endpoint, source FROM steps JOIN touched USING (upto, endpoint, source) GROUP BY upto, endpoint, source
        HAVING count(*) >= 10 AND count(*) FILTER (gap = 1) > (count(*) - 1) * 0.7)"""


@query("l7_streaming_anomalies", _L7)
def _(spark, d):
    # profiles come from the first third, without one endpoint; the rest arrives as two batches
    rows = views.raw_traffic(spark, d)
    time, second, third = F.col("timestamp"), F.lit(_SECOND).cast("timestamp_ntz"), F.lit(_THIRD).cast("timestamp_ntz")
    told = views.with_pattern(rows.filter(time < second)).filter("path_pattern <> '/internal/metrics'")
    training = anomaly.recorded(anomaly.observations(told, phase=0))
    profiles = materialize(anomaly.train(training, _FIXED_WINDOW), "profiles")
    known = materialize(anomaly.activity(training, profiles), "known")
    folder, store, state = (scratch_path(spark, x) for x in ("arriving", "scores", "stream-state"))
    for part in ((time >= second) & (time < third), time >= third):
        rows.filter(part).write.mode("append").parquet(folder)
        stream = views.with_pattern(spark.readStream.schema(rows.schema).parquet(folder))
        thresholds = {"medium_rpm": _RATES[0], "high_rpm": _RATES[1]}
        _run(jobs.scoring_writer(stream, profiles, store, state, known, once=True, **thresholds))
    found = anomaly.first_per_key(spark.read.parquet(f"{store}/anomalies").drop("batch_id"))
    return found.select("anomaly_type", "endpoint", "source")


_ONLINE = " UNION ALL ".join(
    f"SELECT '{kind}' AS anomaly_type, severity, endpoint, source, score, message FROM ({part})" for kind, part in ANOMALIES_SQL
)


@query("l7_online_training", _ONLINE)
def _(spark, d):
    # files arrive in two steps, in order of time; endpoints train on their first records and are scored from then on
    store, state, folder = (scratch_path(spark, x) for x in ("behaviour", "stream-state", "arriving"))
    rows, cut = views.raw_traffic(spark, d), F.lit("2024-01-11 00:00:00").cast("timestamp_ntz")
    for part in (F.col("timestamp") < cut, F.col("timestamp") >= cut):
        rows.filter(part).write.mode("append").parquet(folder)
        stream = views.with_pattern(spark.readStream.schema(rows.schema).parquet(folder))
        _run(jobs.behaviour_writer(stream, store, state, once=True, training_window=WINDOW))
    return stored_anomalies(spark, store).select("anomaly_type", "severity", "endpoint", "source", r6("score"), "message")


@query("a14_compacted_days", "SELECT CAST(\"timestamp\" AS DATE)::VARCHAR AS day, method, count(*) AS calls FROM traffic GROUP BY ALL")
def _(spark, d):
    # four batches: two are merged into days, a third after them, and one is read as it arrived
    store, rows = scratch_path(spark, "layout"), views.traffic(spark, d)
    for batch in range(4):
        store_traffic(rows.filter(F.col("record_id") % 4 == batch), store, batch)
        if batch in (1, 2):
            compact_traffic(spark, store, batch)
    day = F.col("timestamp").cast("date").cast("string").alias("day")
    return read_traffic(spark, store).groupBy(day, "method").agg(F.count("*").alias("calls"))


@query("l8_progress", "SELECT count(*) AS records, (SELECT count(*) FROM inv) AS total_endpoints FROM traffic")
def _(spark, d):
    progress = spark.read.parquet(f"{_store(spark, d)}/progress")
    return progress.agg(F.sum("records").alias("records"), F.max("total_endpoints").alias("total_endpoints"))


@query(
    "l9_windowed_timeline",
    f"SELECT * FROM ({HOURLY}) WHERE strptime(bucket, '%Y-%m-%d %H:%M:%S.%f') + INTERVAL 1 HOUR <= (SELECT max(\"timestamp\") FROM traffic) - INTERVAL 1 HOUR",
)
def _(spark, d):
    out, state = scratch_path(spark, "timeline"), scratch_path(spark, "timeline-state")
    _run(jobs.timeline_writer(views.traffic_stream(spark, d), out, state, once=True))
    return spark.read.parquet(out).select(text("bucket"), "requests", "errors", r6("avg_latency"))
