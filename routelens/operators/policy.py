"""Proposed spec against live inventory."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions.paths import UNAUTH_EXEMPT_PREFIXES, is_infra_path, starts_with_any
from routelens.functions.pytext import plain, quoted_list
from routelens.plans.shared import top_k_per_group

# Default thresholds.
MIN_BREAKING_CALLS = 1
DEPRECATED_CALLS = 100
CONSUMER_SAMPLE = 5

KEY = ["method", "path"]


def inventory_by_route(endpoints: DataFrame) -> DataFrame:
    """One endpoint per (method, path) across hosts: the last in (status, method, path) order.

    Equal statuses are settled by endpoint id.
    """
    carried = ["total_calls", "last_seen", "consumer_count", "auth_methods_seen"]
    last = F.max(F.struct("status", "endpoint_id", *carried))
    return endpoints.groupBy("method", F.col("path_pattern").alias("path")).agg(last.alias("ep")).select(*KEY, "ep.*")


def compare(endpoints: DataFrame, spec: DataFrame) -> DataFrame:
    """Full outer comparison of routes; ``spec`` has ``(method, path, deprecated)`` rows."""
    wanted = spec.groupBy(*KEY).agg(F.max("deprecated").alias("deprecated"), F.lit(True).alias("in_spec"))
    known = inventory_by_route(endpoints).withColumn("in_inventory", F.lit(True))
    both = known.join(wanted, KEY, "full")
    return both.withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("in_spec", "in_inventory", "deprecated")}
    )


def removed_routes(endpoints: DataFrame, spec: DataFrame) -> DataFrame:
    return inventory_by_route(endpoints).join(spec.select(*KEY), KEY, "left_anti")


def added_routes(endpoints: DataFrame, spec: DataFrame) -> DataFrame:
    known = endpoints.select("method", F.col("path_pattern").alias("path"))
    return spec.select(*KEY).distinct().join(known, KEY, "left_anti")


def first_consumers(consumers: DataFrame, k: int = CONSUMER_SAMPLE) -> DataFrame:
    """The first ``k`` consumers of each endpoint by first appearance, as a short array."""
    few = top_k_per_group(consumers, ["endpoint_id"], [F.col("first_seen"), F.col("consumer")], k)
    ranked = F.sort_array(F.collect_list(F.struct("_rank", "consumer")))
    return few.groupBy("endpoint_id").agg(F.transform(ranked, lambda x: x["consumer"]).alias("first_consumers"))


def violations(
    endpoints: DataFrame,
    spec: DataFrame,
    consumers: DataFrame | None = None,
    fail_on_breaking: bool = True,
    fail_on_shadow: bool = True,
    min_traffic_for_breaking: int = MIN_BREAKING_CALLS,
    deprecation_traffic_threshold: int = DEPRECATED_CALLS,
) -> DataFrame:
    """All rule violations from one join: each route yields the rules it breaks.

    ``consumers`` (endpoint_id, consumer, first_seen) supplies the names shown for rule 4.
    """
    routes = compare(endpoints, spec)
    if consumers is None:
        routes = routes.withColumn("first_consumers", F.array().cast("array<string>"))
    else:
        routes = routes.join(first_consumers(consumers), "endpoint_id", "left")
    name = F.concat_ws(" ", "method", "path")
    calls = F.col("total_calls")
    count = calls.cast("string")
    gone = F.col("in_inventory") & ~F.col("in_spec")
    kept = F.col("in_inventory") & F.col("in_spec")
    infra = is_infra_path(F.col("path"))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def rule(condition: Column, rule_name: str, severity: str, message: Column, details: Column | None = None):
        body = F.lit(None).cast("string") if details is None else details
        return F.when(
            condition,
            F.struct(
                F.lit(severity).alias("severity"), F.lit(rule_name).alias("rule"), message.alias("message"),
                body.alias("details"),
            ),
        )

    busy = calls >= min_traffic_for_breaking
    exempt = starts_with_any(F.col("path"), UNAUTH_EXEMPT_PREFIXES)
    rules = [
        rule(gone & busy & (F.col("status") == "active"), "BREAKING_CHANGE",
             "error" if fail_on_breaking else "warning",
             text("Removing ", name, " which has active traffic (", count, " calls)"),
             text("Last seen: ", plain(F.col("last_seen")), ", consumers: ", F.col("consumer_count").cast("string"))),
        rule(gone & busy & (F.col("status") != "active"), "ENDPOINT_REMOVAL", "warning",
             text("Removing ", name, " which has ", count, " historical calls")),
        rule(gone & (calls > 0) & infra, "INFRA_ENDPOINT_NOT_IN_SPEC", "info",
             text("Infrastructure endpoint ", name, " not in spec (OK if intentional)")),
        rule(gone & (calls > 0) & ~infra, "SHADOW_POLICY_VIOLATION", "error" if fail_on_shadow else "warning",
             text(name, " has traffic (", count, " calls) but is not in the spec"),
             text("Status: ", F.col("status"), ", auth: ", quoted_list(F.col("auth_methods_seen")))),
        rule(F.col("in_spec") & ~F.col("in_inventory"), "NEW_ENDPOINT", "info",
             text("New endpoint ", name, " added to spec (no traffic history yet)")),
        rule(kept & F.col("deprecated") & (calls > deprecation_traffic_threshold), "DEPRECATED_HIGH_TRAFFIC",
             "warning",
             text(name, " is deprecated but has ", count, " calls. Consumers may break when removed."),
             text("Consumers: ", quoted_list(F.coalesce("first_consumers", F.array().cast("array<string>"))))),
        rule(kept & F.array_contains("auth_methods_seen", "none") & ~exempt, "UNAUTHENTICATED_IN_SPEC", "warning",
             text(name, " is in the spec but receives unauthenticated traffic")),
    ]
    rows = routes.select(name.alias("endpoint"), F.explode(F.array(*rules)).alias("v"))
    return rows.filter("v is not null").select("v.severity", "v.rule", "v.message", "endpoint", "v.details")


def validation_result(endpoints: DataFrame, spec: DataFrame, found: DataFrame) -> DataFrame:
    """One row: counters and whether the build passes."""
    zero = F.lit(0).cast("bigint")
    routes = compare(endpoints, spec).agg(
        F.count_if("in_spec").alias("spec_endpoints"),
        zero.alias("inventory_endpoints"),
        F.count_if(F.col("in_spec") & ~F.col("in_inventory")).alias("new_in_spec"),
        F.count_if(F.col("in_inventory") & ~F.col("in_spec")).alias("removed_from_spec"),
        zero.alias("errors"),
        zero.alias("warnings"),
    )
    names = routes.columns
    rows = endpoints.agg(F.count("*").alias("inventory_endpoints"))
    broken = found.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    parts = routes.unionByName(rows, allowMissingColumns=True).unionByName(broken, allowMissingColumns=True)
    totals = parts.agg(*[F.sum(n).alias(n) for n in names])
    return totals.select((F.col("errors") == 0).alias("passed"), *names)


def annotations(found: DataFrame) -> DataFrame:
    """CI annotation lines."""
    level = F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise(
        "notice"
    )
    line = F.concat(F.lit("::"), level, F.lit(" title="), F.col("rule"), F.lit("::"), F.col("message"))
    return found.select(line.alias("line"))
