"""Alerts over a classified inventory, their storage form and acknowledgement."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions.pytext import iso, percent, plain
from routelens.operators.inventory import error_rate, is_new

# Alert type, severity and the prefix its message starts with.
ALERT_KINDS = {
    "shadow_api": ("high", "🔴 SHADOW API: "),
    "unauthenticated": ("high", "⚠️  UNAUTHENTICATED: "),
    "high_error_rate": ("medium", "🟡 HIGH ERROR RATE: "),
    "new_endpoint": ("info", "🆕 NEW ENDPOINT: "),
    "zombie_api": ("low", "💀 ZOMBIE API: "),
}
# The high-error rule wants more than 10 calls and more than half of them failing.
HIGH_ERROR_CALLS = 10
HIGH_ERROR_RATE = 0.5
# Words that type a free-text alert, first hit wins.
ALERT_WORDS = (
    ("SHADOW", "shadow_api", "high"),
    ("UNAUTHENTICATED", "unauthenticated", "high"),
    ("HIGH ERROR", "high_error_rate", "medium"),
    ("NEW ENDPOINT", "new_endpoint", "info"),
    ("ZOMBIE", "zombie_api", "low"),
)


def _rules(as_of: Column) -> dict[str, tuple[Column, list[Column]]]:
    """Condition and the end of the message of each kind."""
    calls = F.col("total_calls")
    rate = error_rate(F.col("error_count"), calls)
    status = F.col("status")
    call_text = calls.cast("string")
    return {
        "shadow_api": (status == "shadow", [F.lit(" ("), call_text, F.lit(" calls, not in any spec)")]),
        "unauthenticated": (
            F.array_contains("auth_methods_seen", "none") & (calls > 0),
            [F.lit(" receives unauthenticated traffic")],
        ),
        "high_error_rate": (
            (calls > HIGH_ERROR_CALLS) & (rate > HIGH_ERROR_RATE),
            [F.lit(" ("), percent(rate), F.lit(" errors over "), call_text, F.lit(" calls)")],
        ),
        "new_endpoint": (
            is_new(F.col("first_seen"), as_of),
            [F.lit(" (first seen "), iso(F.col("first_seen")), F.lit(")")],
        ),
        "zombie_api": (
            status == "zombie",
            [F.lit(" (in spec but no traffic since "), plain(F.col("last_seen")), F.lit(")")],
        ),
    }


def alert_kinds(as_of: Column) -> Column:
    """The kinds of alerts that a classified endpoint raises, at most five."""
    kinds = [F.when(condition, F.lit(kind)) for kind, (condition, _) in _rules(as_of).items()]
    return F.filter(F.array(*kinds), lambda x: x.isNotNull())


def generate_alerts(endpoints: DataFrame, as_of: Column) -> DataFrame:
    """All alerts in one pass: up to five per endpoint, with type and severity as columns."""
    raised = []
    for kind, (condition, tail) in _rules(as_of).items():
        severity, prefix = ALERT_KINDS[kind]
        message = F.concat(F.lit(prefix), F.col("method"), F.lit(" "), F.col("path_pattern"), *tail)
        raised.append(
            F.when(
                condition,
                F.struct(
                    F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"), message.alias("message")
                ),
            )
        )
    rows = endpoints.select("endpoint_id", F.explode(F.array(*raised)).alias("alert"))
    return rows.filter("alert is not null").select("endpoint_id", "alert.*", as_of.cast("timestamp_ntz").alias("created_at"))


def sorted_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy("message", "endpoint_id")


def type_messages(messages: DataFrame) -> DataFrame:
    """Type and severity of free-text alerts in column ``message``, by the words they contain."""
    kind = F.lit("other")
    severity = F.lit("info")
    for word, name, level in reversed(ALERT_WORDS):
        hit = F.col("message").contains(word)
        kind = F.when(hit, name).otherwise(kind)
        severity = F.when(hit, level).otherwise(severity)
    return messages.withColumns({"alert_type": kind, "severity": severity})


def unseen_alerts(alerts: DataFrame, stored: DataFrame) -> DataFrame:
    """Alerts not stored before, one per (endpoint, type): what an append may add."""
    return alerts.join(stored.select("endpoint_id", "alert_type"), ["endpoint_id", "alert_type"], "left_anti")


def with_acknowledged(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with their acknowledged flag; ``acks`` is append-only ``(endpoint_id, alert_type)``."""
    marks = acks.select("endpoint_id", "alert_type").distinct().withColumn("_ack", F.lit(True))
    joined = alerts.join(marks, ["endpoint_id", "alert_type"], "left")
    return joined.withColumn("acknowledged", F.coalesce("_ack", F.lit(False))).drop("_ack")


def latest_alerts(alerts: DataFrame, unacknowledged_only: bool = False, limit: int = 100) -> DataFrame:
    if unacknowledged_only:
        alerts = alerts.filter(~F.col("acknowledged"))
    return alerts.orderBy(F.desc("created_at"), "endpoint_id", "alert_type").limit(limit)
