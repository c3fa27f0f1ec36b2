"""Run ledger, audit trail, sessions and login lockout as append-only tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.plans.shared import materialize, spread_join

# Five failures since the last success lock an account for 15 minutes.
LOCKOUT_FAILURES = 5
LOCKOUT_MINUTES = 15


def run_event(run_id: Column, status: str, at: Column, **fields: Column) -> list[Column]:
    """Columns of one ledger event: ``running``, ``completed`` or ``failed: <error>``."""
    names = {"scan_type": "string", "targets": "string", "endpoints_found": "bigint",
             "new_endpoints": "bigint", "alerts_generated": "bigint", "error": "string"}
    extra = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]
    return [run_id.alias("run_id"), F.lit(status).alias("event"), at.cast("timestamp_ntz").alias("at"), *extra]


def run_history(events: DataFrame) -> DataFrame:
    """Ledger events -> one row per run with its latest state.

    ``max`` over the event columns picks the one event that carries a value.
    """
    started = F.col("event") == "running"
    text = F.when(F.col("event") == "failed", F.concat(F.lit("failed: "), F.coalesce("error", F.lit("")))).otherwise(
        F.col("event")
    )
    return events.groupBy("run_id").agg(
        F.max(F.when(started, F.col("scan_type"))).alias("scan_type"),
        F.max(F.when(started, F.col("targets"))).alias("targets"),
        F.coalesce(F.max("endpoints_found"), F.lit(0)).alias("endpoints_found"),
        F.coalesce(F.max("new_endpoints"), F.lit(0)).alias("new_endpoints"),
        F.coalesce(F.max("alerts_generated"), F.lit(0)).alias("alerts_generated"),
        F.min(F.when(started, F.col("at"))).alias("started_at"),
        F.max(F.when(~started, F.col("at"))).alias("completed_at"),
        F.max_by(text, F.struct("at", (~started).alias("ended"))).alias("status"),
    )


def latest_runs(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.orderBy(F.desc("started_at"), F.desc("run_id")).limit(limit)


def audit_event(action: Column, at: Column, details: Column | None = None, **fields: Column) -> list[Column]:
    """Columns of one audit row; ``details`` is a map or struct stored as JSON."""
    names = {"user_id": "bigint", "username": "string", "resource_type": "string", "resource_id": "string",
             "method": "string", "path": "string", "ip_address": "string", "user_agent": "string",
             "status_code": "int"}
    extra = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names.items()]
    body = F.lit(None).cast("string") if details is None else F.to_json(details)
    return [at.cast("timestamp_ntz").alias("timestamp"), action.alias("action"), *extra, body.alias("details")]


def audit_log(
    audit: DataFrame, action: str | None = None, username: str | None = None, limit: int = 200
) -> DataFrame:
    if action:
        audit = audit.filter(F.col("action") == action)
    if username:
        audit = audit.filter(F.col("username") == username)
    return audit.orderBy(F.desc("timestamp"), F.desc("audit_id")).limit(limit)


def valid_sessions(sessions: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Sessions that have not expired and belong to an active user."""
    active = users.filter("is_active").select("user_id", "username", "role", "is_active")
    return sessions.filter(F.col("expires_at") > as_of).join(active, "user_id")


def login_state(audit: DataFrame) -> DataFrame:
    """Per user: last login, failures since then, and until when the account is locked.

    The last success per user is a small table of its own.  Everything else is a plain
    aggregation, so one user with most of the attempts is combined map-side.
    """
    logins = audit.filter(F.col("action").isin("login_success", "login_failure")).select(
        "username", "action", F.struct("timestamp", "audit_id").alias("at")
    )
    last = logins.groupBy("username").agg(
        F.max(F.when(F.col("action") == "login_success", F.col("at"))).alias("last_login")
    )
    failed = logins.filter(F.col("action") == "login_failure").select("username", "at")
    last = materialize(last, "last-login")
    open_failures = spread_join(failed, last, ["username"], F.col("at.audit_id")).filter(
        F.col("last_login").isNull() | (F.col("at") > F.col("last_login"))
    )
    counted = open_failures.groupBy("username").agg(
        F.count("*").alias("failures"), F.max("at.timestamp").alias("last_failure")
    )
    locked = F.col("failures") >= LOCKOUT_FAILURES
    return last.join(counted, "username", "left").select(
        "username",
        F.col("last_login.timestamp").alias("last_login_at"),
        F.coalesce("failures", F.lit(0)).alias("failed_login_count"),
        F.when(locked, F.col("last_failure") + F.make_dt_interval(mins=F.lit(LOCKOUT_MINUTES))).alias("locked_until"),
    )
