"""Endpoint inventory: aggregation, merging, spec correlation, classification, report.

The aggregation state has one row per (endpoint, consumer): see ``schemas.ENDPOINT_PARTS``.  The
unbounded list of consumers is therefore always rows, never an array, and one hot endpoint is
spread over as many groups as it has consumers.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from routelens.functions.auth import auth_bits, auth_names, source_bits, source_names
from routelens.functions.paths import endpoint_id, inventory_consumer, non_empty
from routelens.plans.shared import running_sums
from routelens.schemas import ENDPOINT_STATUSES, ENDPOINTS

KEY = ["method", "host", "path_pattern"]
# Thresholds of classification and report.
ZOMBIE_DAYS = 30
NEW_HOURS = 24


def endpoint_parts(traffic: DataFrame) -> DataFrame:
    """Traffic with ``path_pattern`` -> mergeable state, one shuffle with map-side combining."""
    consumer = inventory_consumer(F.col("auth_subject"), F.col("source_ip"), F.col("source_service"))
    return traffic.groupBy(*KEY, consumer.alias("consumer")).agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.sum("response_time_ms").alias("latency_sum"),
        F.count("response_time_ms").alias("latency_count"),
        F.bit_or(auth_bits(F.col("auth_method"))).alias("auth_bits"),
        F.bit_or(source_bits(F.col("discovery_source"))).alias("source_bits"),
    )


def merge_parts(*states: DataFrame) -> DataFrame:
    """Fold states of different batches into one: old inventory plus new batch, in any order."""
    both = states[0]
    for state in states[1:]:
        both = both.unionByName(state)
    return both.groupBy(*KEY, "consumer").agg(*_merged())


def _merged() -> list[Column]:
    return [
        F.sum("calls").alias("calls"),
        F.sum("errors").alias("errors"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.sum("latency_sum").alias("latency_sum"),
        F.sum("latency_count").alias("latency_count"),
        F.bit_or("auth_bits").alias("auth_bits"),
        F.bit_or("source_bits").alias("source_bits"),
    ]


def endpoints_from_parts(parts: DataFrame) -> DataFrame:
    """Roll the state up to one row per endpoint, unclassified."""
    rolled = parts.groupBy(*KEY).agg(*_merged(), F.count("consumer").alias("consumer_count"))
    return rolled.select(
        endpoint_id(F.col("method"), F.col("host"), F.col("path_pattern")).alias("endpoint_id"),
        *[F.col(c) for c in ("method", "path_pattern", "host")],
        F.lit(None).cast("string").alias("service_name"),
        F.lit(None).cast("string").alias("owning_team"),
        F.lit("undocumented").alias("status"),
        auth_names(F.col("auth_bits")).alias("auth_methods_seen"),
        source_names(F.col("source_bits")).alias("discovery_sources"),
        "consumer_count",
        "first_seen",
        "last_seen",
        F.col("calls").alias("total_calls"),
        F.col("errors").alias("error_count"),
        F.when(F.col("latency_count") > 0, F.col("latency_sum") / F.col("latency_count")).alias(
            "avg_response_time_ms"
        ),
        F.lit(False).alias("declared_in_spec"),
    )


def build_endpoints(traffic: DataFrame) -> DataFrame:
    return endpoints_from_parts(endpoint_parts(traffic))


def endpoint_consumers(parts: DataFrame) -> DataFrame:
    """The distinct consumers of every endpoint, one row each, with first appearance."""
    return parts.filter("consumer is not null").select(
        endpoint_id(F.col("method"), F.col("host"), F.col("path_pattern")).alias("endpoint_id"),
        "consumer",
        "calls",
        "errors",
        "first_seen",
    )


def error_rate(errors: Column, calls: Column) -> Column:
    return F.when(calls > 0, errors / calls).otherwise(F.lit(0.0))


def new_endpoints(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Endpoints of a batch that the inventory does not hold yet."""
    return batch.join(known.select("endpoint_id"), "endpoint_id", "left_anti")


def running_average(traffic: DataFrame) -> DataFrame:
    """The order-dependent running average per endpoint, ``avg = (avg * (n-1) + x) / n``.

    ``n`` counts every call, also those without a response time, so with gaps this is not the
    mean.  Each step is ``avg -> a * avg + b``.  Such steps compose, so every chunk of an
    endpoint's rows is reduced to one (a, b) pair and only the pairs are folded in order.
    """
    known = F.col("response_time_ms").isNotNull()
    keyed = traffic.select(
        endpoint_id(F.col("method"), F.col("host"), F.col("path_pattern")).alias("endpoint_id"),
        "timestamp", "record_id", "response_time_ms",
    )
    ranked = running_sums(
        keyed, ["endpoint_id"], ["timestamp", "record_id"], {"n": F.lit(1), "known": known.cast("int")}
    )
    timed = ranked.filter(known)
    first = F.col("known") == 1
    steps = timed.withColumns(
        {
            "log_a": F.when(first, 0.0).otherwise(F.log((F.col("n") - 1) / F.col("n"))),
            "b": F.when(first, F.col("response_time_ms")).otherwise(F.col("response_time_ms") / F.col("n")),
        }
    )
    # latest rows first: a frame that ends in the past is summed in one pass, while one that ends at
    # the last row is summed anew for every row
    latest_first = Window.partitionBy("endpoint_id", "_chunk").orderBy(F.desc("n"))
    later = F.sum("log_a").over(latest_first.rowsBetween(Window.unboundedPreceding, -1))
    weighted = steps.withColumn("wb", F.col("b") * F.exp(F.coalesce(later, F.lit(0.0))))
    pairs = weighted.groupBy("endpoint_id", "_chunk").agg(
        F.exp(F.sum("log_a")).alias("a"), F.sum("wb").alias("b")
    )
    folded = pairs.groupBy("endpoint_id").agg(
        F.sort_array(F.collect_list(F.struct("_chunk", "a", "b"))).alias("steps")  # one per chunk
    )
    return folded.select(
        "endpoint_id",
        F.aggregate("steps", F.lit(0.0), lambda acc, s: acc * s["a"] + s["b"]).alias("running_avg_ms"),
    )


def correlate_spec(endpoints: DataFrame, spec: DataFrame) -> DataFrame:
    """Merge declared endpoints ``(method, path, host, deprecated)`` into the inventory.

    Declared-only endpoints are added without traffic and without first/last seen.
    """
    routes = spec.groupBy(
        F.col("method").alias("_method"), F.col("path").alias("_path"), non_empty(F.col("host")).alias("_host")
    ).agg(F.max("deprecated").alias("_deprecated"))
    key = endpoint_id(F.col("_method"), F.col("_host"), F.col("_path"))
    declared = routes.withColumn("endpoint_id", key)
    both = endpoints.join(declared, "endpoint_id", "full")
    in_spec = F.col("_method").isNotNull()
    sources = F.coalesce("discovery_sources", F.array().cast("array<string>"))
    changes = {
        "method": F.coalesce("method", "_method"),
        "path_pattern": F.coalesce("path_pattern", "_path"),
        "host": F.coalesce("host", "_host"),
        "status": F.when(F.col("_deprecated"), "deprecated").otherwise(
            F.coalesce("status", F.lit("undocumented"))
        ),
        "auth_methods_seen": F.coalesce("auth_methods_seen", F.array().cast("array<string>")),
        "discovery_sources": F.when(
            in_spec, F.sort_array(F.array_union(sources, F.array(F.lit("scan_openapi"))))
        ).otherwise(sources),
        "consumer_count": F.coalesce("consumer_count", F.lit(0)),
        "total_calls": F.coalesce("total_calls", F.lit(0)),
        "error_count": F.coalesce("error_count", F.lit(0)),
        "declared_in_spec": in_spec | F.coalesce("declared_in_spec", F.lit(False)),
    }
    return both.withColumns(changes).select(*ENDPOINTS.fieldNames())


def is_recent(last_seen: Column, as_of: Column, zombie_days: int = ZOMBIE_DAYS) -> Column:
    recent = last_seen > as_of - F.make_dt_interval(F.lit(zombie_days))
    return F.coalesce(recent, F.lit(False))


def is_new(first_seen: Column, as_of: Column) -> Column:
    return F.coalesce(first_seen > as_of - F.make_dt_interval(hours=F.lit(NEW_HOURS)), F.lit(False))


def classify(endpoints: DataFrame, as_of: Column, zombie_days: int = ZOMBIE_DAYS) -> DataFrame:
    """Set ``status``; deprecated endpoints stay deprecated."""
    declared, called = F.col("declared_in_spec"), F.col("total_calls") > 0
    recent = is_recent(F.col("last_seen"), as_of, zombie_days)
    status = (
        F.when(F.col("status") == "deprecated", "deprecated")
        .when(declared & called & recent, "active")
        .when(declared & ~recent, "zombie")
        .when(called & ~declared, "shadow")
        .otherwise("undocumented")
    )
    return endpoints.withColumn("status", status)


def upsert_endpoints(stored: DataFrame, incoming: DataFrame, null_erases: bool = False) -> DataFrame:
    """Stored snapshot + incoming cumulative rows -> next snapshot.

    Incoming values replace stored ones except: first/last seen keep the extremes, a declaration
    is never taken back, service name and team stay as stored.  ``null_erases=True`` lets a
    missing incoming first/last seen erase the stored one.
    """
    old, new = stored.alias("o"), incoming.alias("n")
    both = old.join(new, "endpoint_id", "full")
    present = F.col("n.method").isNotNull()

    def extreme(pick, name: str) -> Column:
        o, n = F.col(f"o.{name}"), F.col(f"n.{name}")
        if null_erases:
            return F.when(o.isNull() & F.col("o.method").isNull(), n).when(~present, o).when(
                o.isNull() | n.isNull(), n
            ).otherwise(pick(o, n))
        return pick(o, n)

    special = {
        "endpoint_id": F.col("endpoint_id"),
        "first_seen": extreme(F.least, "first_seen"),
        "last_seen": extreme(F.greatest, "last_seen"),
        "declared_in_spec": F.coalesce("o.declared_in_spec", F.lit(False))
        | F.coalesce("n.declared_in_spec", F.lit(False)),
        "service_name": F.when(F.col("o.method").isNotNull(), F.col("o.service_name")).otherwise(
            F.col("n.service_name")
        ),
        "owning_team": F.when(F.col("o.method").isNotNull(), F.col("o.owning_team")).otherwise(
            F.col("n.owning_team")
        ),
    }
    taken = {
        c: F.when(present, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        for c in ENDPOINTS.fieldNames()
        if c not in special
    }
    return both.select(*[{**special, **taken}[c].alias(c) for c in ENDPOINTS.fieldNames()])


def report_counts(as_of: Column) -> list[Column]:
    """The counts of a summary, which add up over parts of an inventory."""
    by_status = [
        F.count_if(F.col("status") == s).alias(f"{s}_endpoints")
        for s in ("active", "shadow", "zombie", "undocumented")
    ]
    return [
        F.count("*").alias("total_endpoints"),
        *by_status,
        F.count_if(F.array_contains("auth_methods_seen", "none")).alias("unauthenticated_endpoints"),
        F.count_if(is_new(F.col("first_seen"), as_of)).alias("new_last_24h"),
    ]


def report(endpoints: DataFrame, as_of: Column) -> DataFrame:
    """One-row summary of a classified inventory."""
    return endpoints.agg(*report_counts(as_of))


def changes_at(as_of: Column, zombie_days: int = ZOMBIE_DAYS) -> Column:
    """When the passing of time alone changes an endpoint's status or its place in the summary; NULL for never."""
    last, first = F.col("last_seen"), F.col("first_seen")
    ages = F.when(F.col("declared_in_spec") & is_recent(last, as_of, zombie_days), last + F.make_dt_interval(F.lit(zombie_days)))
    return F.least(ages, F.when(is_new(first, as_of), first + F.make_dt_interval(hours=F.lit(NEW_HOURS))))


def ordered(endpoints: DataFrame) -> DataFrame:
    return endpoints.orderBy("status", "method", "path_pattern", "endpoint_id")


def by_status(endpoints: DataFrame, status: str) -> DataFrame:
    if status not in ENDPOINT_STATUSES:
        raise ValueError(f"unknown status {status!r}")
    return endpoints.filter(F.col("status") == status).orderBy("method", "path_pattern", "endpoint_id")


def by_id(endpoints: DataFrame, wanted: str) -> DataFrame:
    return endpoints.filter(F.col("endpoint_id") == wanted)


def search(endpoints: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search; ``%`` and ``_`` in the query act as wildcards."""
    like = f"%{query}%"
    hit = F.col("path_pattern").ilike(like) | F.col("host").ilike(like) | F.col("service_name").ilike(like)
    return endpoints.filter(hit)
