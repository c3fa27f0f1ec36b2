"""Statistics over stored traffic, dashboards and metrics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.plans.shared import union_all
from routelens.schemas import ALERT_SEVERITIES, ENDPOINT_STATUSES

# Upper bounds of the latency histogram, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def trailing(traffic: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Rows of the last ``hours`` up to ``as_of``.

    With traffic partitioned by ``dt`` the second condition prunes partitions.
    """
    start = as_of - F.make_dt_interval(hours=F.lit(hours))
    rows = traffic.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= as_of))
    if "dt" in traffic.columns:
        rows = rows.filter((F.col("dt") >= start.cast("date")) & (F.col("dt") <= as_of.cast("date")))
    return rows


def traffic_stats(traffic: DataFrame) -> DataFrame:
    """One row of totals.

    Rows are first combined per (pattern, client), so that the two distinct counts run over those
    few groups instead of over several copies of every log row.
    """
    small = traffic.groupBy("path_pattern", "source_ip").agg(
        F.count("*").alias("n"),
        F.sum("response_time_ms").alias("ms"),
        F.count("response_time_ms").alias("timed"),
        F.count_if(F.col("status_code") >= 400).alias("e4"),
        F.count_if(F.col("status_code") >= 500).alias("e5"),
    )
    totals = small.agg(
        F.sum("n").alias("n"),
        F.countDistinct("path_pattern").alias("unique_endpoints"),
        F.countDistinct("source_ip").alias("unique_clients"),
        F.sum("ms").alias("ms"),
        F.sum("timed").alias("timed"),
        F.sum("e4").alias("error_count"),
        F.sum("e5").alias("server_errors"),
    )
    mean = F.when(F.col("timed") > 0, F.col("ms") / F.col("timed"))
    return totals.select(
        F.coalesce("n", F.lit(0)).alias("total_requests"),
        "unique_endpoints",
        "unique_clients",
        F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_latency_ms"),
        "error_count",  # NULL without rows, like the sums they come from
        "server_errors",
    )


def top_endpoints(traffic: DataFrame, limit: int = 10) -> DataFrame:
    grouped = traffic.filter("path_pattern is not null").groupBy("path_pattern", "method")
    calls = grouped.agg(F.count("*").alias("calls"), F.avg("response_time_ms").alias("avg_latency"))
    return calls.orderBy(F.desc("calls"), "path_pattern", "method").limit(limit)


def top_errors(traffic: DataFrame, limit: int = 10) -> DataFrame:
    failed = traffic.filter("path_pattern is not null and status_code >= 400")
    counts = failed.groupBy("path_pattern", "method", "status_code").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "path_pattern", "method", "status_code").limit(limit)


def timeline(traffic: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """Requests, errors and mean latency per time bucket, in time order.

    Works on batch and streaming input alike (leave out the ordering for a stream).
    """
    out = timeline_buckets(traffic, bucket_minutes)
    return out if traffic.isStreaming else out.orderBy("bucket")


def timeline_buckets(traffic: DataFrame, bucket_minutes: int) -> DataFrame:
    bucket = F.window("timestamp", f"{bucket_minutes} minutes")
    grouped = traffic.groupBy(bucket).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.avg("response_time_ms").alias("avg_latency"),
    )
    return grouped.select(F.col("window.start").alias("bucket"), "requests", "errors", "avg_latency")


def request_counters(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy("method", "path_pattern", "status_code").agg(F.count("*").alias("requests"))


def latency_histogram(traffic: DataFrame) -> DataFrame:
    """Cumulative histogram rows ``(method, path_pattern, le, count)`` plus sum and count.

    All bounds are counted in the one aggregation; the unpivot runs on the aggregated rows.
    """
    seconds = F.col("response_time_ms") / 1000
    timed = traffic.filter("response_time_ms is not null")
    counts = timed.groupBy("method", "path_pattern").agg(
        *[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(LATENCY_BOUNDS)],
        F.count("*").alias("n"),
        F.sum(seconds).alias("sum_seconds"),
    )
    bounds = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("c")) for i, b in enumerate(LATENCY_BOUNDS)]
    bounds.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("c")))
    rows = counts.select("method", "path_pattern", "sum_seconds", "n", F.explode(F.array(*bounds)).alias("b"))
    return rows.select(
        "method", "path_pattern", F.col("b.le").alias("le"), F.col("b.c").alias("cumulative_count"),
        "sum_seconds", F.col("n").alias("total_count"),
    )


def dashboard_summary(endpoints: DataFrame, alerts: DataFrame) -> DataFrame:
    """Counts by status (zero-filled), unauthenticated endpoints and open alerts, one row."""
    counts = endpoints.agg(
        F.count("*").alias("total_endpoints"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ENDPOINT_STATUSES],
        F.count_if(F.array_contains("auth_methods_seen", "none")).alias("unauthenticated"),
        F.lit(0).cast("bigint").alias("active_alerts"),
    )
    names = counts.columns
    open_alerts = alerts.agg(F.count_if(~F.col("acknowledged")).alias("active_alerts"))
    padded = open_alerts.select(
        *[F.lit(0).cast("bigint").alias(c) for c in names[:-1]], F.col("active_alerts")
    )
    return counts.unionByName(padded).agg(*[F.sum(c).alias(c) for c in names])


def inventory_gauges(endpoints: DataFrame, alerts: DataFrame) -> DataFrame:
    """Gauge rows ``(gauge, label, value)`` over the fixed label sets, zero-filled."""

    def filled(counts: DataFrame, gauge: str, labels: tuple[str, ...]) -> DataFrame:
        # one aggregated row, then one output row per label of the fixed set
        pairs = [F.struct(F.lit(n).alias("label"), F.col(n).alias("value")) for n in labels]
        return counts.select(F.lit(gauge).alias("gauge"), F.inline(F.array(*pairs)))

    status = endpoints.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ENDPOINT_STATUSES])
    severity = alerts.filter(~F.col("acknowledged")).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ALERT_SEVERITIES]
    )
    return union_all(
        [
            filled(status, "inventory_endpoints", ENDPOINT_STATUSES),
            filled(severity, "alerts_open", ALERT_SEVERITIES),
        ]
    )
