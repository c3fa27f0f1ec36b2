"""Traffic statistics, dashboards, accounts: parts of B, C, D, F."""

from pyspark.sql import functions as F

from routelens.functions import paths
from routelens.operators import accounts, traffic as stats
from workload import views
from workload.q_inventory import classified, flagged_alerts
from workload.q_sources import _RUNS, run_columns
from workload.registry import query, r6, text
from workload.sql import AS_OF, ts


@query("b8_nginx_noise", "SELECT method, count(*) AS kept FROM nginx GROUP BY method")
def _(spark, d):
    from routelens.sources import logs

    rows = logs.parse_lines(views.nginx_lines(spark, d), "nginx", views.as_of())
    return rows.groupBy("method").agg(F.count("*").alias("kept"))


def _audit_columns():
    return ["audit_id", text("timestamp"), "action", "username"]


@query(
    "b13_audit_filter",
    f"""SELECT audit_id, {ts('tm')} AS "timestamp", action, username FROM audit WHERE action = 'login_failure' AND username = 'user-7'
    ORDER BY tm DESC, audit_id DESC LIMIT 200""",
)
def _(spark, d):
    return accounts.audit_log(views.audit(spark, d), "login_failure", "user-7").select(*_audit_columns())


@query(
    "b14_trailing_hours",
    f"""SELECT method, count(*) AS calls FROM traffic WHERE "timestamp" >= {AS_OF} - INTERVAL 48 HOUR AND "timestamp" <= {AS_OF} GROUP BY method""",
)
def _(spark, d):
    rows = stats.trailing(views.traffic(spark, d), views.as_of(), 48)
    return rows.groupBy("method").agg(F.count("*").alias("calls"))


@query(
    "b16_infra_paths",
    """SELECT path_pattern, regexp_matches(path_pattern, '^(/health|/ready|/metrics|/internal/|/\\.well-known/)') AS infra, count(*) AS calls
    FROM traffic GROUP BY path_pattern""",
)
def _(spark, d):
    infra = paths.is_infra_path(F.col("path_pattern")).alias("infra")
    return views.traffic(spark, d).groupBy("path_pattern", infra).agg(F.count("*").alias("calls"))


@query(
    "c9_valid_sessions",
    f"""SELECT 's-' || event_id AS session_id, user_id, 'user-' || user_id AS username,
    CASE WHEN user_id % 10 = 0 THEN 'admin' ELSE 'viewer' END AS role, {ts('ts + INTERVAL 7 DAY')} AS expires_at
    FROM events WHERE event_type = 'view' AND ts + INTERVAL 7 DAY > {AS_OF} AND user_id % 7 <> 0""",
)
def _(spark, d):
    live = accounts.valid_sessions(views.sessions(spark, d), views.users(spark, d), views.as_of())
    return live.select("session_id", "user_id", "username", "role", text("expires_at"))


_RECENT = f"""(SELECT * FROM traffic WHERE "timestamp" >= {AS_OF} - INTERVAL 168 HOUR AND "timestamp" <= {AS_OF})"""


def recent(spark, d):
    return stats.trailing(views.traffic(spark, d), views.as_of(), 168)


@query(
    "d7_traffic_stats",
    f"""SELECT count(*) AS total_requests, count(DISTINCT path_pattern) AS unique_endpoints, count(DISTINCT source_ip) AS unique_clients,
    round(coalesce(avg(response_time_ms), 0), 2) AS avg_latency_ms, count(*) FILTER (status_code >= 400) AS error_count,
    count(*) FILTER (status_code >= 500) AS server_errors FROM {_RECENT}""",
)
def _(spark, d):
    return stats.traffic_stats(recent(spark, d))


@query(
    "d8_top_endpoints",
    f"""SELECT path_pattern, method, count(*) AS calls, round(avg(response_time_ms) + 1e-9, 6) AS avg_latency FROM {_RECENT}
    GROUP BY path_pattern, method ORDER BY calls DESC, path_pattern, method LIMIT 10""",
)
def _(spark, d):
    return stats.top_endpoints(recent(spark, d)).select("path_pattern", "method", "calls", r6("avg_latency"))


@query(
    "d9_top_errors",
    f"""SELECT path_pattern, method, status_code, count(*) AS count FROM {_RECENT} WHERE status_code >= 400
    GROUP BY path_pattern, method, status_code ORDER BY count DESC, path_pattern, method, status_code LIMIT 10""",
)
def _(spark, d):
    return stats.top_errors(recent(spark, d))


_BUCKET = f"""SELECT {ts('bucket')} AS bucket, count(*) AS requests, count(*) FILTER (status_code >= 400) AS errors,
    round(avg(response_time_ms) + 1e-9, 6) AS avg_latency FROM (SELECT *, %s AS bucket FROM traffic) GROUP BY 1"""
HOURLY = _BUCKET.replace("%s", "date_trunc('hour', \"timestamp\")")


@query("d10_timeline", HOURLY)
def _(spark, d):
    return stats.timeline(views.traffic(spark, d)).select(text("bucket"), "requests", "errors", r6("avg_latency"))


@query("d10_timeline_15_minutes", _BUCKET.replace("%s", "time_bucket(INTERVAL 15 MINUTE, \"timestamp\")"))
def _(spark, d):
    return stats.timeline(views.traffic(spark, d), 15).select(text("bucket"), "requests", "errors", r6("avg_latency"))


@query(
    "d11_dashboard_summary",
    """SELECT count(*) AS total_endpoints, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'shadow') AS shadow,
    count(*) FILTER (status = 'zombie') AS zombie, count(*) FILTER (status = 'undocumented') AS undocumented,
    count(*) FILTER (status = 'deprecated') AS deprecated, count(*) FILTER (list_contains(auth, 'none')) AS unauthenticated,
    (SELECT count(*) FROM flagged WHERE NOT acknowledged) AS active_alerts FROM ep""",
)
def _(spark, d):
    return stats.dashboard_summary(classified(spark, d), flagged_alerts(spark, d))


@query(
    "d12_inventory_gauges",
    """SELECT 'inventory_endpoints' AS gauge, s AS label, count(ep.status) AS value FROM
    (VALUES ('active'), ('shadow'), ('zombie'), ('undocumented'), ('deprecated')) v(s) LEFT JOIN ep ON ep.status = s GROUP BY s
    UNION ALL SELECT 'alerts_open', s, count(f.severity) FROM (VALUES ('high'), ('medium'), ('low'), ('info')) v(s)
    LEFT JOIN (SELECT * FROM flagged WHERE NOT acknowledged) f ON f.severity = s GROUP BY s""",
)
def _(spark, d):
    return stats.inventory_gauges(classified(spark, d), flagged_alerts(spark, d))


@query("d13_request_counters", "SELECT method, path_pattern, status_code, count(*) AS requests FROM traffic GROUP BY ALL")
def _(spark, d):
    return stats.request_counters(views.traffic(spark, d))


_BOUNDS = "0.005 0.01 0.025 0.05 0.1 0.25 0.5 1.0 2.5 5.0 10.0".split()


@query(
    "d14_latency_histogram",
    f"""SELECT method, path_pattern, le, count(*) FILTER (response_time_ms / 1000 <= bound) AS cumulative_count,
    round(sum(response_time_ms / 1000) + 1e-9, 6) AS sum_seconds, count(*) AS total_count FROM traffic,
    (VALUES {', '.join(f"('{b}', {b}::DOUBLE)" for b in _BOUNDS)}, ('+Inf', 1e300)) b(le, bound)
    WHERE response_time_ms IS NOT NULL GROUP BY method, path_pattern, le""",
)
def _(spark, d):
    rows = stats.latency_histogram(views.traffic(spark, d))
    return rows.withColumn("sum_seconds", r6("sum_seconds"))


@query(
    "d34_login_lockout",
    f"""SELECT username, strftime(last_login, '%Y-%m-%d %H:%M:%S.%f') AS last_login_at, failures AS failed_login_count,
    CASE WHEN failures >= 5 THEN strftime(last_failure + INTERVAL 15 MINUTE, '%Y-%m-%d %H:%M:%S.%f') END AS locked_until FROM (
    SELECT username, max(tm) FILTER (action = 'login_success') AS last_login,
        count(*) FILTER (action = 'login_failure' AND streak = final) AS failures, max(tm) FILTER (action = 'login_failure' AND streak = final) AS last_failure
    FROM (SELECT *, max(streak) OVER (PARTITION BY username) AS final FROM (SELECT *, sum(CASE WHEN action = 'login_success' THEN 1 ELSE 0 END)
        OVER (PARTITION BY username ORDER BY tm, audit_id) AS streak FROM audit WHERE action IN ('login_success', 'login_failure')))
    GROUP BY username)""",
)
def _(spark, d):
    return accounts.login_state(views.audit(spark, d)).select(
        "username", text("last_login_at"), "failed_login_count", text("locked_until")
    )


@query("f4_latest_runs", f"SELECT * FROM ({_RUNS}) ORDER BY started_at DESC, run_id DESC LIMIT 20")
def _(spark, d):
    return accounts.latest_runs(accounts.run_history(views.run_events(spark, d))).select(*run_columns())


@query(
    "f5_latest_audit",
    f"""SELECT audit_id, {ts('tm')} AS "timestamp", action, username FROM audit ORDER BY tm DESC, audit_id DESC LIMIT 200""",
)
def _(spark, d):
    return accounts.audit_log(views.audit(spark, d)).select(*_audit_columns())
