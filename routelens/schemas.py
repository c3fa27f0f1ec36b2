"""Table shapes and closed value sets shared by every operator.

All functions of the package pass DataFrames with these columns around.  Event times are
``timestamp_ntz`` (wall clock of the log), so results never depend on the session time zone.
"""

from pyspark.sql import types as T

# The closed enumerations of the data model.
AUTH_METHODS = ("bearer", "api_key", "basic", "none", "unknown")
DISCOVERY_SOURCES = (
    "log_nginx",
    "log_alb",
    "log_api_gateway",
    "log_generic",
    "scan_network",
    "scan_openapi",
)
ENDPOINT_STATUSES = ("active", "shadow", "zombie", "undocumented", "deprecated")
ALERT_SEVERITIES = ("high", "medium", "low", "info")
SPEC_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")

TRAFFIC = T.StructType(
    [
        T.StructField("record_id", T.LongType()),  # breaks ties between equal timestamps
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("source_service", T.StringType()),
        T.StructField("auth_method", T.StringType()),
        T.StructField("auth_subject", T.StringType()),
        T.StructField("response_time_ms", T.DoubleType()),
        T.StructField("host", T.StringType()),
        T.StructField("discovery_source", T.StringType()),
    ]
)

# The inventory's mergeable state, one row per (endpoint, consumer).  Every measure is a sum,
# a min, a max or a bit set, so states of different batches add up in any order.
ENDPOINT_PARTS = T.StructType(
    [
        T.StructField("method", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("path_pattern", T.StringType()),
        T.StructField("consumer", T.StringType()),
        T.StructField("calls", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("first_seen", T.TimestampNTZType()),
        T.StructField("last_seen", T.TimestampNTZType()),
        T.StructField("latency_sum", T.DoubleType()),
        T.StructField("latency_count", T.LongType()),
        T.StructField("auth_bits", T.IntegerType()),
        T.StructField("source_bits", T.IntegerType()),
    ]
)

ENDPOINTS = T.StructType(
    [
        T.StructField("endpoint_id", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path_pattern", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("owning_team", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("auth_methods_seen", T.ArrayType(T.StringType())),
        T.StructField("discovery_sources", T.ArrayType(T.StringType())),
        T.StructField("consumer_count", T.LongType()),
        T.StructField("first_seen", T.TimestampNTZType()),
        T.StructField("last_seen", T.TimestampNTZType()),
        T.StructField("total_calls", T.LongType()),
        T.StructField("error_count", T.LongType()),
        T.StructField("avg_response_time_ms", T.DoubleType()),
        T.StructField("declared_in_spec", T.BooleanType()),
    ]
)
