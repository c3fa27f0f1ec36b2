"""Spec against inventory: H9 - H18 and parts of C, D, F, G."""

from pyspark.sql import functions as F

from routelens.operators import inventory, policy
from routelens.plans.shared import materialize, union_all
from workload import views
from workload.q_inventory import specs
from workload.registry import joined, query, text
from workload.sql import ts

_LAST = """(SELECT *, path_pattern AS path FROM (SELECT *, row_number() OVER (PARTITION BY method, path_pattern ORDER BY status DESC, endpoint_id DESC) AS f
    FROM ep) WHERE f = 1)"""


def _written(spark, d):
    """Classified endpoints and their consumers, from one written state table."""
    state = materialize(inventory.endpoint_parts(views.traffic(spark, d)), "parts")
    return inventory.endpoints_from_parts(state), inventory.endpoint_consumers(state)


def classified(spark, d):
    """Endpoints classified against the full spec."""
    rows = inventory.correlate_spec(_written(spark, d)[0], specs(spark, d))
    return inventory.classify(rows, views.as_of())


# the proposed spec drops POST routes and adds a new one
_PROPOSED = "(SELECT * FROM routes WHERE method <> 'POST' UNION ALL SELECT DISTINCT 'PUT', '/api/v9/' || method, false FROM routes)"


def proposed(spark, d):
    current = specs(spark, d).groupBy("method", "path").agg(F.max("deprecated").alias("deprecated"))
    extra = current.select(F.lit("PUT").alias("method"), F.concat(F.lit("/api/v9/"), "method").alias("path"), F.lit(False).alias("deprecated"))
    return current.filter("method <> 'POST'").unionByName(extra.distinct())


@query("c3_removed_routes", f"SELECT method, path, total_calls, status FROM {_LAST} e WHERE NOT EXISTS (SELECT 1 FROM {_PROPOSED} p WHERE p.method = e.method AND p.path = e.path)")
def _(spark, d):
    return policy.removed_routes(classified(spark, d), proposed(spark, d)).select("method", "path", "total_calls", "status")


@query("c4_routes_in_both", f"SELECT e.method, e.path, p.deprecated FROM {_LAST} e JOIN {_PROPOSED} p ON p.method = e.method AND p.path = e.path")
def _(spark, d):
    both = policy.compare(classified(spark, d), proposed(spark, d)).filter("in_spec and in_inventory")
    return both.select("method", "path", "deprecated")


@query(
    "c14_inventory_by_route",
    f"SELECT method, path, status, endpoint_id, total_calls, array_to_string(auth, ',') AS auth_methods_seen, {ts('last_seen')} AS last_seen FROM {_LAST}",
)
def _(spark, d):
    return policy.inventory_by_route(classified(spark, d)).select(
        "method", "path", "status", "endpoint_id", "total_calls", joined("auth_methods_seen"), text("last_seen")
    )


@query("g1_inventory_minus_spec", f"SELECT method, path_pattern AS path FROM ep EXCEPT SELECT method, path FROM {_PROPOSED}")
def _(spark, d):
    return policy.removed_routes(classified(spark, d), proposed(spark, d)).select("method", "path")


@query("g2_spec_minus_inventory", f"SELECT method, path FROM {_PROPOSED} EXCEPT SELECT method, path_pattern FROM ep")
def _(spark, d):
    return policy.added_routes(classified(spark, d), proposed(spark, d))


@query("g3_deprecated_in_inventory", f"SELECT method, path FROM {_PROPOSED} WHERE deprecated INTERSECT SELECT method, path_pattern FROM ep")
def _(spark, d):
    known = classified(spark, d).select("method", F.col("path_pattern").alias("path"))
    return proposed(spark, d).filter("deprecated").select("method", "path").intersect(known)


_FIRST5 = """(SELECT endpoint_id, string_agg('''' || consumer || '''', ', ' ORDER BY f) AS names FROM (SELECT *, row_number() OVER
    (PARTITION BY endpoint_id ORDER BY first_seen, consumer) AS f FROM cons) WHERE f <= 5 GROUP BY endpoint_id)"""
_INFRA = "regexp_matches(coalesce(e.path, s.path), '^(/health|/ready|/metrics|/internal/|/\\.well-known/)')"
_BOTH = f"""SELECT coalesce(e.method, s.method) || ' ' || coalesce(e.path, s.path) AS endpoint, e.total_calls AS calls, e.status, e.consumer_count, e.last_seen,
    e.auth, c.names, coalesce(s.deprecated, false) AS deprecated, s.method IS NOT NULL AS in_spec, e.method IS NOT NULL AS in_inv, {_INFRA} AS infra
    FROM {_LAST} e FULL JOIN {_PROPOSED} s ON e.method = s.method AND e.path = s.path LEFT JOIN {_FIRST5} c ON c.endpoint_id = e.endpoint_id"""
_RULES = {
    "h9_breaking_change": (
        "BREAKING_CHANGE", "error", "in_inv AND NOT in_spec AND calls >= 1 AND status = 'active'",
        "'Removing ' || endpoint || ' which has active traffic (' || calls || ' calls)'",
        "'Last seen: ' || strftime(last_seen, '%Y-%m-%d %H:%M:%S.%f') || ', consumers: ' || consumer_count",
    ),
    "h10_endpoint_removal": (
        "ENDPOINT_REMOVAL", "warning", "in_inv AND NOT in_spec AND calls >= 1 AND status <> 'active'",
        "'Removing ' || endpoint || ' which has ' || calls || ' historical calls'", "NULL",
    ),
    "h11_infra_not_in_spec": (
        "INFRA_ENDPOINT_NOT_IN_SPEC", "info", "in_inv AND NOT in_spec AND calls > 0 AND infra",
        "'Infrastructure endpoint ' || endpoint || ' not in spec (OK if intentional)'", "NULL",
    ),
    "h12_shadow_policy": (
        "SHADOW_POLICY_VIOLATION", "error", "in_inv AND NOT in_spec AND calls > 0 AND NOT infra",
        "endpoint || ' has traffic (' || calls || ' calls) but is not in the spec'",
        "'Status: ' || status || ', auth: [' || array_to_string(list_transform(auth, lambda a: '''' || a || ''''), ', ') || ']'",
    ),
    "h13_new_endpoint": (
        "NEW_ENDPOINT", "info", "in_spec AND NOT in_inv",
        "'New endpoint ' || endpoint || ' added to spec (no traffic history yet)'", "NULL",
    ),
    "h14_deprecated_high_traffic": (
        "DEPRECATED_HIGH_TRAFFIC", "warning", "in_spec AND in_inv AND deprecated AND calls > 100",
        "endpoint || ' is deprecated but has ' || calls || ' calls. Consumers may break when removed.'",
        "'Consumers: [' || coalesce(names, '') || ']'",
    ),
    "h15_unauthenticated_in_spec": (
        "UNAUTHENTICATED_IN_SPEC", "warning",
        "in_spec AND in_inv AND list_contains(auth, 'none') AND NOT regexp_matches(split_part(endpoint, ' ', 2), '^(/health|/ready|/metrics)')",
        "endpoint || ' is in the spec but receives unauthenticated traffic'", "NULL",
    ),
}


def _rule_sql(rule: str) -> str:
    name, severity, condition, message, details = _RULES[rule]
    return f"SELECT '{severity}' AS severity, '{name}' AS rule, {message} AS message, endpoint, {details} AS details FROM ({_BOTH}) WHERE {condition}"


_ALL = " UNION ALL ".join(_rule_sql(r) for r in _RULES)


def violations(spark, d, **options):
    endpoints, consumers = _written(spark, d)
    rows = inventory.classify(inventory.correlate_spec(endpoints, specs(spark, d)), views.as_of())
    return policy.violations(rows, proposed(spark, d), consumers, **options)


def _rule_query(key: str) -> None:
    name = _RULES[key][0]

    @query(key, _rule_sql(key))
    def _(spark, d):
        return violations(spark, d).filter(F.col("rule") == name)


for _key in _RULES:
    _rule_query(_key)


@query(
    "h16_passed",
    f"SELECT count(*) FILTER (severity = 'error') = 0 AS strict, count(*) FILTER (severity = 'error' AND rule = 'none') = 0 AS lenient FROM ({_ALL})",
)
def _(spark, d):
    strict = violations(spark, d).agg((F.count_if(F.col("severity") == "error") == 0).alias("strict"), F.lit(True).alias("lenient"))
    relaxed = violations(spark, d, fail_on_breaking=False, fail_on_shadow=False).agg(
        F.lit(True).alias("strict"), (F.count_if(F.col("severity") == "error") == 0).alias("lenient")
    )
    return strict.unionByName(relaxed).agg(F.bool_and("strict").alias("strict"), F.bool_and("lenient").alias("lenient"))


_OPTIONS = [(b, w) for b in (True, False) for w in (True, False)]


@query(
    "h16_passed_by_option",
    f"""SELECT breaking, shadow, count(*) FILTER (level = 'error') = 0 AS passed, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings
    FROM (SELECT o.*, CASE WHEN rule = 'BREAKING_CHANGE' AND NOT breaking OR rule = 'SHADOW_POLICY_VIOLATION' AND NOT shadow THEN 'warning' ELSE severity END AS level
    FROM ({_ALL}), (VALUES (true, true), (true, false), (false, true), (false, false)) o(breaking, shadow)) GROUP BY breaking, shadow""",
)
def _(spark, d):
    parts = []
    for breaking, shadow in _OPTIONS:
        found = violations(spark, d, fail_on_breaking=breaking, fail_on_shadow=shadow)
        errors, warnings = (F.count_if(F.col("severity") == x) for x in ("error", "warning"))
        parts.append(found.agg(F.lit(breaking).alias("breaking"), F.lit(shadow).alias("shadow"), (errors == 0).alias("passed"), errors.alias("errors"), warnings.alias("warnings")))
    return union_all(parts)


@query(
    "d30_validation_counters",
    f"""SELECT count(*) FILTER (severity = 'error') = 0 AS passed, (SELECT count(*) FROM (SELECT DISTINCT method, path FROM {_PROPOSED})) AS spec_endpoints,
    (SELECT count(*) FROM ep) AS inventory_endpoints, count(*) FILTER (rule = 'NEW_ENDPOINT') AS new_in_spec,
    (SELECT count(*) FROM (SELECT method, path_pattern FROM ep EXCEPT SELECT method, path FROM {_PROPOSED})) AS removed_from_spec,
    count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM ({_ALL})""",
)
def _(spark, d):
    found = materialize(violations(spark, d), "violations")
    return policy.validation_result(classified(spark, d), proposed(spark, d), found)


@query(
    "h18_ci_annotations",
    f"SELECT '::' || CASE severity WHEN 'info' THEN 'notice' ELSE severity END || ' title=' || rule || '::' || message AS line FROM ({_ALL})",
)
def _(spark, d):
    return policy.annotations(violations(spark, d))
