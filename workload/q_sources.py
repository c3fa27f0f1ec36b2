"""A: scans, formats, specs, sinks."""

from pyspark.sql import functions as F

from routelens.operators import accounts, alerts, inventory
from routelens.plans.shared import scratch_path
from routelens.schemas import ENDPOINTS
from routelens.sources import logs, openapi, tables
from routelens.streaming import jobs
from workload import views
from workload.q_inventory import classified, half
from workload.registry import joined, query, r6, text
from workload.sql import ts

_RECORD = ["method", "path", "status_code", "source_ip", "auth_method", "auth_subject", "host"]


def _parsed(df):
    seconds = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at")
    return df.select(*_RECORD, r6("response_time_ms"), "discovery_source", seconds)


def _expected(name: str) -> str:
    return f"""SELECT method, path, status_code, source_ip, auth_method, auth_subject, host,
        round(response_time_ms + 1e-9, 6) AS response_time_ms, discovery_source, strftime(sec, '%Y-%m-%d %H:%M:%S') AS at
        FROM {name}"""


def _parse(spark, sf_dir, lines, name):
    return _parsed(logs.parse_lines(lines(spark, sf_dir), name, views.as_of()))


@query("a1_text_log_scan", _expected("gtext"))
def _(spark, d):
    folders = views.log_files(spark, d, "generic", blanks=True)
    return _parsed(logs.parse_lines(logs.scan_lines(spark, folders), "generic", views.as_of()))


@query("a2_nginx_format", _expected("nginx"))
def _(spark, d):
    return _parse(spark, d, views.nginx_lines, "nginx")


@query("a3_alb_format", _expected("alb"))
def _(spark, d):
    return _parse(spark, d, views.alb_lines, "alb")


@query("a4_api_gateway_format", _expected("gateway"))
def _(spark, d):
    return _parse(spark, d, views.gateway_lines, "apigateway")


@query("a5_generic_json", _expected("gjson"))
def _(spark, d):
    return _parse(spark, d, views.generic_json_lines, "generic")


@query("a6_generic_text", _expected("gtext"))
def _(spark, d):
    return _parse(spark, d, views.generic_text_lines, "generic")


@query("a7_json_text_dispatch", f"{_expected('gjson')} UNION ALL {_expected('gtext')}")
def _(spark, d):
    mixed = views.generic_json_lines(spark, d).unionByName(views.generic_text_lines(spark, d))
    return _parsed(logs.parse_lines(mixed, "generic", views.as_of()))


_FOUR = ("nginx", "alb", "gateway", "gtext")


@query("a8_format_detection", " UNION ALL ".join(_expected(name) for name in _FOUR))
def _(spark, d):
    folders = views.log_files(spark, d, "nginx", "alb", "apigateway", "generic")
    return _parsed(logs.read_logs(spark, folders, views.as_of()))


_PATTERNED = """(SELECT *, CASE WHEN regexp_replace(rtrim(path, '/'), '/[0-9]+', '/{id}', 'g') = '' THEN '/' ELSE
    regexp_replace(rtrim(path, '/'), '/[0-9]+', '/{id}', 'g') END AS path_pattern FROM (SELECT * FROM nginx UNION ALL SELECT * FROM gtext))"""


@query(
    "a9_multi_file_ingest",
    f"""SELECT method, path_pattern, count(*) AS total_calls, count(*) FILTER (status_code >= 400) AS error_count,
    array_to_string(list_sort(list(DISTINCT discovery_source)), ',') AS discovery_sources,
    array_to_string(list_sort(list(DISTINCT auth_method)), ',') AS auth_methods_seen,
    count(DISTINCT source_ip) AS consumer_count FROM {_PATTERNED} GROUP BY method, path_pattern""",
)
def _(spark, d):
    folders = views.log_files(spark, d, "nginx", "generic")
    traffic = logs.with_pattern(logs.read_logs(spark, folders, views.as_of()))
    return inventory.build_endpoints(traffic).select(
        "method", "path_pattern", "total_calls", "error_count", joined("discovery_sources"),
        joined("auth_methods_seen"), "consumer_count",
    )


@query("a10_spec_files", "SELECT DISTINCT method, path, deprecated FROM spec")
def _(spark, d):
    docs = views.spec_documents(spark, d).select(F.md5("spec_json").alias("doc"), "spec_json").distinct()
    folder = scratch_path(spark, "specs")
    docs.write.partitionBy("doc").text(folder)
    found = openapi.read_specs(spark, f"{folder}/*")
    return openapi.spec_operations(found).select("method", "path", "deprecated").distinct()


# members that are no path items, documents cut short, and a list where paths should be
@query(
    "a10_irregular_specs",
    "SELECT DISTINCT 'operation' AS kind, method, path FROM spec UNION ALL SELECT 'unreadable', h, NULL FROM (SELECT DISTINCT coalesce(host, 'none') AS h FROM spec)",
)
def _(spark, d):
    docs = views.spec_documents(spark, d)
    odd = F.concat(F.lit('{"paths":{"x-owner":"team","/null":null,"/list":[{"get":{}}],"x-tags":["a"],'), F.expr("substring(spec_json, instr(spec_json, '\"paths\":{') + 9)"))
    cut = docs.select(F.coalesce("host", F.lit("none")).alias("host"), F.expr("substring(spec_json, 1, length(spec_json) - 1)").alias("spec_json"))
    listed = docs.select("host", F.lit('{"paths":[1,2]}').alias("spec_json"))
    mixed = docs.select("host", odd.alias("spec_json")).unionByName(cut).unionByName(listed)
    found = openapi.spec_operations(mixed, skip_unreadable=True).select(F.lit("operation").alias("kind"), "method", "path").distinct()
    bad = openapi.unreadable_specs(mixed).select(F.lit("unreadable").alias("kind"), F.col("host").alias("method"), F.lit(None).cast("string").alias("path"))
    return found.unionByName(bad.distinct())


@query("a11_spec_endpoints", "SELECT DISTINCT method, path FROM spec")
def _(spark, d):
    return openapi.spec_endpoints(views.spec_documents(spark, d))


@query("a12_deprecated_endpoints", "SELECT DISTINCT method, path FROM spec WHERE deprecated")
def _(spark, d):
    return openapi.deprecated_endpoints(views.spec_documents(spark, d))


@query(
    "a13_declared_endpoints",
    """SELECT method, path AS path_pattern, host, CASE WHEN deprecated THEN 'deprecated' ELSE 'active' END AS status,
    true AS declared_in_spec, 'scan_openapi' AS discovery_source FROM spec""",
)
def _(spark, d):
    return openapi.declared_endpoints(views.spec_documents(spark, d))


@query(
    "a14_append_traffic",
    """SELECT strftime("timestamp", '%Y-%m-%d') AS day, path_pattern, count(*) AS calls FROM traffic GROUP BY day, path_pattern""",
)
def _(spark, d):
    path = scratch_path(spark, "traffic")
    tables.append_traffic(views.traffic(spark, d), path, views.as_of())
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("dt").cast("string").alias("day"), "path_pattern").agg(F.count("*").alias("calls"))


@query(
    "a15_upsert_endpoints",
    f"""SELECT coalesce(o.endpoint_id, n.endpoint_id) AS endpoint_id, coalesce(n.total_calls, o.total_calls) AS total_calls,
    coalesce(n.error_count, o.error_count) AS error_count, {ts('least(o.first_seen, n.first_seen)')} AS first_seen,
    {ts('greatest(o.last_seen, n.last_seen)')} AS last_seen, array_to_string(coalesce(n.auth, o.auth), ',') AS auth_methods_seen
    FROM half1 o FULL JOIN half2 n ON o.endpoint_id = n.endpoint_id""",
)
def _(spark, d):
    stored = inventory.build_endpoints(half(spark, d, 1))
    incoming = inventory.build_endpoints(half(spark, d, 2))
    return inventory.upsert_endpoints(stored, incoming).select(
        "endpoint_id", "total_calls", "error_count", text("first_seen"), text("last_seen"), joined("auth_methods_seen")
    )


@query(
    "a16_load_inventory",
    "SELECT endpoint_id, status, method, path_pattern, total_calls FROM ep ORDER BY status, method, path_pattern, endpoint_id",
)
def _(spark, d):
    root = scratch_path(spark, "store")
    tables.write_snapshot(classified(spark, d), root, 7)
    loaded = tables.read_snapshot(spark, root, ENDPOINTS)
    return inventory.ordered(loaded).select("endpoint_id", "status", "method", "path_pattern", "total_calls")


_HALF_ALERTS = """SELECT endpoint_id, 'shadow_api' AS alert_type FROM half1 UNION ALL
    SELECT endpoint_id, 'unauthenticated' FROM half1 WHERE list_contains(auth, 'none') UNION ALL
    SELECT endpoint_id, 'high_error_rate' FROM half1 WHERE total_calls > 10 AND error_count / total_calls > 0.5"""


@query(
    "a17_append_alerts",
    f"""SELECT endpoint_id, alert_type, severity FROM alerts a WHERE NOT EXISTS
    (SELECT 1 FROM ({_HALF_ALERTS}) h WHERE h.endpoint_id = a.endpoint_id AND h.alert_type = a.alert_type)""",
)
def _(spark, d):
    first = inventory.classify(inventory.build_endpoints(half(spark, d, 1)), views.as_of())
    path = scratch_path(spark, "alerts")
    tables.append(alerts.generate_alerts(first, views.as_of()), path)
    raised = alerts.generate_alerts(classified(spark, d), views.as_of())
    return alerts.unseen_alerts(raised, spark.read.parquet(path)).select("endpoint_id", "alert_type", "severity")


_RUNS = """SELECT o_orderkey AS run_id, 'log_analysis' AS scan_type, o_orderpriority AS targets,
    CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END AS endpoints_found,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
    strftime(CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 1 HOUR WHEN 'P' THEN o_orderdate + INTERVAL 2 HOUR END,
        '%Y-%m-%d %H:%M:%S.%f') AS completed_at,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed: timeout' ELSE 'running' END AS status FROM orders"""


def run_columns():
    return ["run_id", "scan_type", "targets", "endpoints_found", text("started_at"), text("completed_at"), "status"]


@query("a18_run_ledger", _RUNS)
def _(spark, d):
    return accounts.run_history(views.run_events(spark, d)).select(*run_columns())


@query("a19_audit_events", f"SELECT audit_id, {ts('tm')} AS \"timestamp\", action, username, details FROM audit")
def _(spark, d):
    path = scratch_path(spark, "audit")
    tables.append(views.audit(spark, d), path)
    return spark.read.parquet(path).select("audit_id", text("timestamp"), "action", "username", "details")


@query(
    "a20_json_report",
    """SELECT '{"endpoint_id":"' || endpoint_id || '","method":"' || method || '","host":' ||
    coalesce('"' || host || '"', 'null') || ',"total_calls":' || total_calls || '}' AS value FROM inv""",
)
def _(spark, d):
    rows = inventory.build_endpoints(views.traffic(spark, d)).select("endpoint_id", "method", "host", "total_calls")
    path = scratch_path(spark, "report")
    tables.write_json_report(rows, path)
    return spark.read.text(path)


@query(
    "a21_tail_source",
    "SELECT method, path, count(*) AS calls FROM gtext GROUP BY method, path",
)
def _(spark, d):
    folder = views.log_files(spark, d, "generic")[0]
    out, state = scratch_path(spark, "tail"), scratch_path(spark, "tail-state")
    stream = jobs.stream_logs(spark, folder, "generic", views.as_of(), max_files=1)
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("method", "path").agg(F.count("*").alias("calls"))


@query("a22_egress_scan_keeps_lines", "SELECT path, status_code, host, true AS has_line FROM alb")
def _(spark, d):
    folders = views.log_files(spark, d, "alb")
    rows = logs.parse_lines(logs.scan_lines(spark, folders), "alb", views.as_of())
    return rows.select("path", "status_code", "host", F.contains("raw_line", "path").alias("has_line"))
