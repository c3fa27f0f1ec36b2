"""Profiles and anomalies: parts of B, C, D, E, F."""

from pyspark.sql import functions as F

from routelens.functions import paths
from routelens.operators import anomaly
from routelens.plans.shared import materialize
from workload import views
from workload.registry import query, r6, text
from workload.sql import WINDOW, ts


def observed(spark, d):
    return anomaly.observations(views.traffic(spark, d))


def scored(spark, d, window: int = WINDOW):
    return anomaly.score(observed(spark, d), training_window=window)


def unscored(spark, d):
    return materialize(anomaly.activity(observed(spark, d)), "activity")


@query("b18_resource_id", "SELECT method, path_pattern, rid AS resource_id, count(*) AS calls FROM obs GROUP BY ALL")
def _(spark, d):
    return observed(spark, d).groupBy("method", "path_pattern", "resource_id").agg(F.count("*").alias("calls"))


def _shown(df, *details):
    extra = [F.col("details")[k].alias(k) for k in details]
    return df.select("endpoint", "source", "severity", r6("score"), text("timestamp"), "message", *extra)


_NEW = f"""SELECT endpoint, source, 'low' AS severity, 0.3::DOUBLE AS score, {ts('tm')} AS "timestamp",
    'New consumer ' || source || ' accessing ' || endpoint AS message FROM newcons"""


@query("c7_unknown_sources", "SELECT endpoint, source FROM early")
def _(spark, d):
    return anomaly.new_consumers(scored(spark, d, 5)).select("endpoint", "source")


@query(
    "c8_records_with_profile",
    "SELECT endpoint, count(*) AS scored, count(*) FILTER (z > 3) AS far FROM scored GROUP BY endpoint",
)
def _(spark, d):
    rows = anomaly.recorded(observed(spark, d))
    profiles = materialize(anomaly.train_then_detect(rows, training_window=WINDOW), "profiles")
    joined = rows.join(profiles, anomaly.ENDPOINT).filter("is_trained and seq > cut")  # no records are identical here
    z = F.when(F.col("std_latency") > 0, F.abs(F.col("latency") - F.col("avg_latency")) / F.col("std_latency"))
    return joined.groupBy(paths.endpoint_name(F.col("method"), F.col("path_pattern")).alias("endpoint")).agg(
        F.count("*").alias("scored"), F.count_if(z > 3).alias("far")
    )


@query(
    "d18_train_profiles",
    f"""SELECT method, path_pattern, count(*) AS sample_count, round(coalesce(avg(latency), 0) + 1e-9, 6) AS avg_latency,
    round(coalesce(stddev_pop(latency), 0) + 1e-9, 6) AS std_latency, count(*) >= 1000 AS is_trained FROM obs GROUP BY method, path_pattern""",
)
def _(spark, d):
    return anomaly.train(observed(spark, d)).select(
        "method", "path_pattern", "sample_count", r6("avg_latency"), r6("std_latency"), "is_trained"
    )


_MAPS = """SELECT method, path_pattern, string_agg(status_code || '=' || n, ',' ORDER BY status_code) AS status_codes FROM
    (SELECT method, path_pattern, status_code, count(*) AS n FROM obs GROUP BY ALL) GROUP BY method, path_pattern"""


def _map_text(c):
    pairs = F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    return F.array_join(pairs, ",").alias("status_codes")


@query("d19_status_distribution", _MAPS)
def _(spark, d):
    return anomaly.status_distribution(observed(spark, d)).select("method", "path_pattern", _map_text("status_codes"))


@query(
    "d20_known_consumers_and_ids",
    """SELECT method, path_pattern, source, NULL AS resource_id FROM obs GROUP BY ALL
    UNION ALL SELECT method, path_pattern, source, rid FROM obs WHERE rid IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    rows = observed(spark, d)
    consumers = anomaly.known_consumers(rows).withColumn("resource_id", F.lit(None).cast("string"))
    return consumers.unionByName(anomaly.known_resource_ids(rows))


_SUMMARY = f"""SELECT o.endpoint, sample_count, sample_count >= 1000 AS is_trained, avg_latency_ms, known_consumers, status_codes FROM
    (SELECT endpoint, method, path_pattern, count(*) AS sample_count, round(coalesce(avg(latency), 0), 2) AS avg_latency_ms,
    count(DISTINCT source) AS known_consumers FROM obs GROUP BY ALL) o JOIN ({_MAPS}) m USING (method, path_pattern)"""


@query("d21_profile_summary", _SUMMARY)
def _(spark, d):
    return anomaly.profile_summary(observed(spark, d)).withColumn("status_codes", _map_text("status_codes"))


@query("f10_profiles_by_samples", f"SELECT endpoint, sample_count FROM ({_SUMMARY}) ORDER BY sample_count DESC, endpoint")
def _(spark, d):
    return anomaly.profile_summary(observed(spark, d)).select("endpoint", "sample_count")


_STUFFING = """SELECT 'multiple' AS endpoint, source, 'critical' AS severity, round(failed / n + 1e-9, 6) AS score, strftime(hi, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
    'Possible credential stuffing from ' || source || ': ' || failed || '/' || n || ' requests failed auth (' || printf('%.0f', failed / n * 100) || '%)' AS message
    FROM bysource WHERE n >= 10 AND failed / n > 0.8"""


@query("d22_credential_stuffing", _STUFFING)
def _(spark, d):
    return _shown(anomaly.credential_stuffing(unscored(spark, d)))


_RPM = "(n / (us / 1000000.0 / 60))"


def _rate_sql(medium: float, high: float) -> str:
    return f"""SELECT 'multiple' AS endpoint, source, CASE WHEN {_RPM} > {high} THEN 'high' ELSE 'medium' END AS severity,
    round(least({_RPM} / 1000, 1.0) + 1e-9, 6) AS score, strftime(hi, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp",
    'High request rate from ' || source || ': ' || printf('%.0f', {_RPM}) || ' requests/min over ' || printf('%.0f', us / 1000000.0) || 's' AS message
    FROM bysource WHERE n >= 5 AND us > 0 AND {_RPM} > {medium}"""


@query("d23_rate_anomaly", _rate_sql(0.001, 0.02))
def _(spark, d):
    # a month of sparse traffic: thresholds are lowered so that sources on both sides exist
    return _shown(anomaly.rate_anomalies(unscored(spark, d), 0.001, 0.02))


_ENUMS = """SELECT endpoint, source, 'high' AS severity, round(seq / (total - 1) + 1e-9, 6) AS score, NULL AS "timestamp",
    'Sequential ID enumeration detected from ' || source || ' on ' || endpoint || ': ' || total || ' IDs, ' || seq || '/' || (total - 1) || ' sequential' AS message
    FROM enums"""


@query(
    "d24_enumeration",
    _ENUMS.replace("AS message", "AS message, total::VARCHAR AS total_ids, lo || '-' || hi AS id_range"),
)
def _(spark, d):
    return _shown(anomaly.enumeration(unscored(spark, d)), "total_ids", "id_range")


_BOLA = f"""SELECT b.endpoint, b.source, 'critical' AS severity, round(least(ids / 100.0, 1.0) + 1e-9, 6) AS score, {ts('tm')} AS "timestamp",
    'Possible BOLA attack: ' || b.source || ' has accessed ' || ids::BIGINT || ' unique resource IDs on ' || b.endpoint AS message
    FROM bola b"""


@query(
    "e1_bola",
    _BOLA.replace("AS message", "AS message, f.sample AS sample_ids") + " JOIN firstids f ON f.endpoint = b.endpoint AND f.source = b.source",
)
def _(spark, d):
    return _shown(anomaly.bola(scored(spark, d)), "sample_ids")


@query(
    "e3_consecutive_ids",
    """SELECT endpoint, source, count(*) AS ids, count(*) FILTER (gap = 1) AS consecutive FROM gaps GROUP BY endpoint, source
    HAVING count(*) >= 10 AND count(*) FILTER (gap = 1) > (count(*) - 1) * 0.7""",
)
def _(spark, d):
    found = anomaly.enumeration(unscored(spark, d))
    return found.select(
        "endpoint", "source", F.col("details")["total_ids"].cast("bigint").alias("ids"),
        F.col("details")["sequential_pairs"].cast("bigint").alias("consecutive"),
    )


@query(
    "e4_train_then_detect",
    f"""SELECT p.endpoint, sample_count, trained AS is_trained, round(mean + 1e-9, 6) AS avg_latency, round(dev + 1e-9, 6) AS std_latency,
    {ts('max(tm)')} AS cut FROM prof p JOIN ranked r ON r.endpoint = p.endpoint AND n <= {WINDOW} GROUP BY ALL""",
)
def _(spark, d):
    profiles = anomaly.train_then_detect(anomaly.recorded(observed(spark, d)), training_window=WINDOW)
    return profiles.select(
        paths.endpoint_name(F.col("method"), F.col("path_pattern")).alias("endpoint"), "sample_count", "is_trained",
        r6("avg_latency"), r6("std_latency"), F.date_format("cut_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("cut"),
    )


_OUTLIERS = f"""SELECT endpoint, source, 'high' AS severity, round(least(z / 10, 1.0) + 1e-9, 6) AS score, {ts('tm')} AS "timestamp",
    'Unusual response time on ' || endpoint || ': ' || printf('%.0f', latency) || 'ms vs avg ' || printf('%.0f', mean) || 'ms (' ||
    printf('%.1f', z) || ' std devs) — possible data exfiltration' AS message FROM outliers"""


@query("e5_latency_outliers", _OUTLIERS)
def _(spark, d):
    return _shown(anomaly.latency_outliers(scored(spark, d)))


@query(
    "e7_call_transitions",
    """SELECT source, previous, endpoint, count(*) AS transitions FROM (SELECT source, endpoint,
    lag(endpoint) OVER (PARTITION BY source ORDER BY tm, record_id) AS previous FROM obs) WHERE previous IS NOT NULL GROUP BY ALL""",
)
def _(spark, d):
    return anomaly.call_transitions(observed(spark, d))


@query("e8_new_consumers", _NEW.replace("FROM newcons", "FROM early"))
def _(spark, d):
    return _shown(anomaly.new_consumers(scored(spark, d, 5)))


ANOMALIES_SQL = (
    ("data_exfiltration", _OUTLIERS), ("bola", _BOLA), ("new_consumer", _NEW), ("credential_stuffing", _STUFFING),
    ("rate_anomaly", _rate_sql(100, 500)), ("enumeration", _ENUMS),
)


@query(
    "e2_first_per_key",
    "SELECT anomaly_type, endpoint, source, min(\"timestamp\") AS \"timestamp\" FROM ("
    + " UNION ALL ".join(f"SELECT '{kind}' AS anomaly_type, endpoint, source, \"timestamp\" FROM ({part})" for kind, part in ANOMALIES_SQL)
    + ") GROUP BY ALL",
)
def _(spark, d):
    once = anomaly.detect(scored(spark, d))
    late = once.withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(F.lit(1)))
    return anomaly.first_per_key(once.unionByName(late)).select("anomaly_type", "endpoint", "source", text("timestamp"))


@query(
    "f8_all_anomalies",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS anomaly_type, severity, endpoint, source, score, message FROM ({part})" for kind, part in ANOMALIES_SQL
    ) + " ORDER BY severity, anomaly_type, source, endpoint",
)
def _(spark, d):
    found = anomaly.detect(scored(spark, d))
    return found.select("anomaly_type", "severity", "endpoint", "source", r6("score"), "message")
