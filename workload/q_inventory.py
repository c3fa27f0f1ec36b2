"""Inventory, classification, alerts: parts of B, C, D, F, G, H."""

import hashlib

from pyspark.sql import functions as F

from routelens.functions import paths
from routelens.operators import alerts, inventory
from routelens.sources import openapi
from workload import views
from workload.registry import joined, query, r6, text
from workload.sql import AS_OF, eid, inventory as inventory_sql, pattern, ts


def half(spark, d, which: int):
    rows = views.traffic(spark, d)
    if which == 1:
        return rows.filter(F.col("timestamp") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return rows.filter(F.col("timestamp") >= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))


def endpoint_rows(spark, d):
    return inventory.build_endpoints(views.traffic(spark, d))


def specs(spark, d):
    return openapi.spec_operations(views.spec_documents(spark, d))


def classified(spark, d):
    return inventory.classify(inventory.correlate_spec(endpoint_rows(spark, d), specs(spark, d)), views.as_of())


def plain_classified(spark, d):
    return inventory.classify(endpoint_rows(spark, d), views.as_of())


def all_alerts(spark, d):
    return alerts.generate_alerts(classified(spark, d), views.as_of())


def flagged_alerts(spark, d):
    return alerts.with_acknowledged(all_alerts(spark, d), views.acknowledgements(spark, d))


# ── B ──

_PAGE_PATH = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"


@query(
    "b1_normalize_path",
    f"""SELECT path, {pattern('path')} AS path_pattern FROM (SELECT path FROM rt UNION SELECT {_PAGE_PATH} FROM pages)""",
)
def _(spark, d):
    urls = views.table(spark, d, "pages").select(paths.url_path(F.col("url")).alias("path"))
    both = views.raw_traffic(spark, d).select("path").union(urls).distinct()
    return both.select("path", paths.normalize_path(F.col("path")).alias("path_pattern"))


@query("b2_endpoint_id", f"SELECT DISTINCT method, host, path_pattern, {eid('method', 'host', 'path_pattern')} AS endpoint_id FROM traffic")
def _(spark, d):
    key = ["method", "host", "path_pattern"]
    return views.traffic(spark, d).select(*key).distinct().select(
        *key, paths.endpoint_id(F.col("method"), F.col("host"), F.col("path_pattern")).alias("endpoint_id")
    )


@query("b3_error_predicates", "SELECT method, count(*) FILTER (status_code >= 400) AS errors, count(*) FILTER (status_code >= 500) AS server_errors FROM rt GROUP BY method")
def _(spark, d):
    return views.raw_traffic(spark, d).groupBy("method").agg(
        F.count_if(F.col("status_code") >= 400).alias("errors"), F.count_if(F.col("status_code") >= 500).alias("server_errors")
    )


def _by(spark, d, column):
    return views.raw_traffic(spark, d).groupBy(column.alias("who")).agg(F.count("*").alias("calls"))


@query("b4_inventory_consumer", "SELECT coalesce(auth_subject, source_ip, source_service) AS who, count(*) AS calls FROM rt GROUP BY who")
def _(spark, d):
    return _by(spark, d, paths.inventory_consumer(F.col("auth_subject"), F.col("source_ip"), F.col("source_service")))


@query("b5_anomaly_source", "SELECT coalesce(source_ip, source_service, 'unknown') AS who, count(*) AS calls FROM rt GROUP BY who")
def _(spark, d):
    return _by(spark, d, paths.anomaly_source(F.col("source_ip"), F.col("source_service")))


@query("b6_egress_source", "SELECT coalesce(source_service, source_ip, 'unknown') AS who, count(*) AS calls FROM rt GROUP BY who")
def _(spark, d):
    return _by(spark, d, paths.egress_source(F.col("source_service"), F.col("source_ip")))


@query(
    "b7_url_parts",
    f"""SELECT page_id, split_part(url, '?', 1) AS bare, {_PAGE_PATH} AS path,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host FROM pages""",
)
def _(spark, d):
    url = F.col("url")
    return views.table(spark, d, "pages").select(
        "page_id", paths.strip_query(url).alias("bare"), paths.url_path(url).alias("path"), paths.url_host(url).alias("host")
    )


@query("b9_endpoints_by_status", "SELECT endpoint_id, method, path_pattern FROM ep WHERE status = 'active' ORDER BY method, path_pattern")
def _(spark, d):
    return inventory.by_status(classified(spark, d), "active").select("endpoint_id", "method", "path_pattern")


_WANTED = hashlib.sha256(b"GET:api.stripe.com:/api/v1/clicks/{id}").hexdigest()[:12]


@query("b10_endpoint_by_id", f"SELECT endpoint_id, method, host, path_pattern, total_calls FROM ep WHERE endpoint_id = '{_WANTED}'")
def _(spark, d):
    return inventory.by_id(classified(spark, d), _WANTED).select("endpoint_id", "method", "host", "path_pattern", "total_calls")


@query("b11_search_endpoints", "SELECT endpoint_id, host, path_pattern FROM ep WHERE path_pattern ILIKE '%STRIPE%' OR host ILIKE '%STRIPE%'")
def _(spark, d):
    return inventory.search(classified(spark, d), "STRIPE").select("endpoint_id", "host", "path_pattern")


_ALERT = "endpoint_id, alert_type, severity, message"


@query("b12_open_alerts", f"SELECT {_ALERT} FROM flagged WHERE NOT acknowledged ORDER BY endpoint_id, alert_type LIMIT 100")
def _(spark, d):
    return alerts.latest_alerts(flagged_alerts(spark, d), unacknowledged_only=True).select(*_ALERT.split(", "))


@query("b19_undocumented_filter", "SELECT endpoint_id, status FROM ep WHERE NOT declared")
def _(spark, d):
    from routelens.operators.remediation import undocumented

    return undocumented(classified(spark, d)).select("endpoint_id", "status")


@query(
    "b20_recent_and_new",
    f"""SELECT endpoint_id, coalesce(last_seen > {AS_OF} - INTERVAL 30 DAY, false) AS recent,
    coalesce(last_seen > {AS_OF} - INTERVAL 1 DAY, false) AS today, coalesce(first_seen > {AS_OF} - INTERVAL 24 HOUR, false) AS is_new FROM corr""",
)
def _(spark, d):
    rows = inventory.correlate_spec(endpoint_rows(spark, d), specs(spark, d))
    last = F.col("last_seen")
    return rows.select(
        "endpoint_id", inventory.is_recent(last, views.as_of()).alias("recent"),
        inventory.is_recent(last, views.as_of(), 1).alias("today"), inventory.is_new(F.col("first_seen"), views.as_of()).alias("is_new"),
    )


# ── C ──

_ENDPOINT = f"""endpoint_id, method, path_pattern, host, array_to_string(auth, ',') AS auth_methods_seen,
    array_to_string(sources, ',') AS discovery_sources, consumer_count, {ts('first_seen')} AS first_seen,
    {ts('last_seen')} AS last_seen, total_calls, error_count, round(avg_ms + 1e-9, 6) AS avg_response_time_ms"""


def _endpoint_columns():
    return [
        "endpoint_id", "method", "path_pattern", "host", joined("auth_methods_seen"), joined("discovery_sources"),
        "consumer_count", text("first_seen"), text("last_seen"), "total_calls", "error_count", r6("avg_response_time_ms"),
    ]


@query("c1_merge_state_and_batch", f"SELECT {_ENDPOINT} FROM inv")
def _(spark, d):
    rows = views.traffic(spark, d)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    state = inventory.endpoint_parts(rows.filter(F.col("timestamp") < cut))
    batch = inventory.endpoint_parts(rows.filter(F.col("timestamp") >= cut))
    return inventory.endpoints_from_parts(inventory.merge_parts(state, batch)).select(*_endpoint_columns())


@query(
    "c2_path_pattern_map",
    """SELECT path_pattern, count(*) AS calls FROM (SELECT CASE WHEN starts_with(path, '/api/v1/clicks/') THEN '/clicks' ELSE path END AS path_pattern
    FROM rt) GROUP BY path_pattern""",
)
def _(spark, d):
    from routelens.sources.logs import with_pattern

    rows = views.raw_traffic(spark, d)
    known = rows.filter(F.col("path").startswith("/api/v1/clicks/")).select("path").distinct()
    mapped = with_pattern(rows, known.withColumn("path_pattern", F.lit("/clicks")))
    return mapped.groupBy("path_pattern").agg(F.count("*").alias("calls"))


@query("c10_correlate_spec", f"SELECT {_ENDPOINT}, declared AS declared_in_spec, st AS status FROM corr")
def _(spark, d):
    rows = inventory.correlate_spec(endpoint_rows(spark, d), specs(spark, d))
    return rows.select(*_endpoint_columns(), "declared_in_spec", "status")


# ── D ──


@query("d1_endpoint_inventory", f"SELECT {_ENDPOINT} FROM inv")
def _(spark, d):
    return endpoint_rows(spark, d).select(*_endpoint_columns())


@query(
    "d2_running_average",
    f"""SELECT endpoint_id, round(sum(CASE WHEN q = 1 THEN x ELSE x / n END * exp(coalesce(later, 0))) + 1e-9, 6) AS running_avg_ms FROM (
    SELECT *, sum(CASE WHEN q = 1 THEN 0 ELSE ln((n - 1) / n) END) OVER (PARTITION BY endpoint_id ORDER BY n DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM (
    SELECT *, row_number() OVER (PARTITION BY endpoint_id ORDER BY n) AS q FROM (
    SELECT {eid('method', 'host', 'path_pattern')} AS endpoint_id, response_time_ms AS x,
        row_number() OVER (PARTITION BY method, host, path_pattern ORDER BY "timestamp", record_id) AS n FROM traffic)
    WHERE x IS NOT NULL)) GROUP BY endpoint_id""",
)
def _(spark, d):
    return inventory.running_average(views.traffic(spark, d)).select("endpoint_id", r6("running_avg_ms"))


@query("d3_error_rate", "SELECT endpoint_id, round(CASE WHEN total_calls > 0 THEN error_count / total_calls ELSE 0 END + 1e-9, 6) AS error_rate FROM ep")
def _(spark, d):
    rate = inventory.error_rate(F.col("error_count"), F.col("total_calls"))
    return classified(spark, d).select("endpoint_id", r6(rate, "error_rate"))


@query("d4_endpoint_consumers", f"SELECT endpoint_id, consumer, calls, errors, {ts('first_seen')} AS first_seen FROM cons")
def _(spark, d):
    rows = inventory.endpoint_consumers(inventory.endpoint_parts(views.traffic(spark, d)))
    return rows.select("endpoint_id", "consumer", "calls", "errors", text("first_seen"))


_EARLY = inventory_sql("(SELECT * FROM traffic WHERE \"timestamp\" < TIMESTAMP '2024-01-02 00:00:00')")


@query(
    "d5_new_endpoints",
    f"SELECT count(*) AS new_endpoints FROM inv WHERE endpoint_id NOT IN (SELECT endpoint_id FROM ({_EARLY}))",
)
def _(spark, d):
    rows = views.traffic(spark, d)
    cut = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    known = inventory.build_endpoints(rows.filter(F.col("timestamp") < cut))
    return inventory.new_endpoints(inventory.build_endpoints(rows), known).agg(F.count("*").alias("new_endpoints"))


@query(
    "d6_inventory_report",
    f"""SELECT count(*) AS total_endpoints, count(*) FILTER (status = 'active') AS active_endpoints,
    count(*) FILTER (status = 'shadow') AS shadow_endpoints, count(*) FILTER (status = 'zombie') AS zombie_endpoints,
    count(*) FILTER (status = 'undocumented') AS undocumented_endpoints, count(*) FILTER (list_contains(auth, 'none')) AS unauthenticated_endpoints,
    count(*) FILTER (first_seen > {AS_OF} - INTERVAL 24 HOUR) AS new_last_24h FROM ep""",
)
def _(spark, d):
    return inventory.report(classified(spark, d), views.as_of())


# ── F, G ──


@query("f1_ordered_endpoints", "SELECT status, method, path_pattern, endpoint_id FROM ep ORDER BY ALL")
def _(spark, d):
    return inventory.ordered(classified(spark, d)).select("status", "method", "path_pattern", "endpoint_id")


@query("f2_sorted_alerts", "SELECT message, endpoint_id FROM alerts ORDER BY ALL")
def _(spark, d):
    return alerts.sorted_alerts(all_alerts(spark, d)).select("message", "endpoint_id")


@query("f3_latest_alerts", f"SELECT {_ALERT} FROM flagged ORDER BY endpoint_id, alert_type LIMIT 100")
def _(spark, d):
    return alerts.latest_alerts(flagged_alerts(spark, d)).select(*_ALERT.split(", "))


@query(
    "g6_union_of_logs",
    "SELECT discovery_source, count(*) AS calls FROM (SELECT * FROM nginx UNION ALL SELECT * FROM alb) GROUP BY discovery_source",
)
def _(spark, d):
    from routelens.sources import logs

    parsed = [
        logs.parse_lines(lines(spark, d), name, views.as_of())
        for name, lines in (("nginx", views.nginx_lines), ("alb", views.alb_lines))
    ]
    return parsed[0].unionByName(parsed[1]).groupBy("discovery_source").agg(F.count("*").alias("calls"))


# ── H1 - H8 ──


@query("h1_classify", "SELECT endpoint_id, status FROM ep")
def _(spark, d):
    return classified(spark, d).select("endpoint_id", "status")


def _alert_query(key: str, kind: str, expected_source: str = "alerts"):
    @query(key, f"SELECT {_ALERT} FROM {expected_source} WHERE alert_type = '{kind}'")
    def _(spark, d):
        return all_alerts(spark, d).filter(F.col("alert_type") == kind).select(*_ALERT.split(", "))


_alert_query("h2_shadow_alerts", "shadow_api")
_alert_query("h3_unauthenticated_alerts", "unauthenticated")
_alert_query("h4_high_error_alerts", "high_error_rate")
_alert_query("h6_zombie_alerts", "zombie_api")


# as_of of its own: the first day, when most endpoints are new
_DAY1 = "TIMESTAMP '2024-01-02 00:00:00'"


@query(
    "h5_new_endpoint_alerts",
    f"""SELECT endpoint_id, 'info' AS severity, '🆕 NEW ENDPOINT: ' || method || ' ' || path_pattern || ' (first seen ' ||
    strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%f') || ')' AS message FROM inv WHERE first_seen > {_DAY1} - INTERVAL 24 HOUR""",
)
def _(spark, d):
    at = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    raised = alerts.generate_alerts(inventory.classify(endpoint_rows(spark, d), at), at)
    return raised.filter("alert_type = 'new_endpoint'").select("endpoint_id", "severity", "message")


@query("h7_alert_types", "SELECT message, alert_type, severity FROM alerts")
def _(spark, d):
    return alerts.type_messages(all_alerts(spark, d).select("message"))


@query("h8_acknowledged_alerts", "SELECT endpoint_id, alert_type, acknowledged FROM flagged")
def _(spark, d):
    return flagged_alerts(spark, d).select("endpoint_id", "alert_type", "acknowledged")
