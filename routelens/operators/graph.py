"""Service dependency graph: construction, reachability, exports.

``nodes`` has one row per service, ``edges`` one per (source, target).  An edge's methods are a
small set; its paths are kept as rows of their own, only a sample is ever an array.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions.paths import consumer_node_name, non_empty
from routelens.operators.egress import UNKNOWN_PROVIDER
from routelens.operators.inventory import error_rate
from routelens.plans.shared import materialize, union_all

UNKNOWN_SERVICE = "unknown-service"
# A single point of failure takes more than 30 % of all nodes with it.
SPOF_SHARE = 0.3
CRITICAL_LIMIT = 10
EDGE_PATH_SAMPLE = 5


def service_name(service: Column, host: Column) -> Column:
    return F.coalesce(non_empty(service), non_empty(host), F.lit(UNKNOWN_SERVICE))


def _calls(endpoints: DataFrame, consumers: DataFrame) -> DataFrame:
    """(consumer node, service, endpoint) rows.  Every consumer is charged the endpoint's totals."""
    totals = endpoints.select(
        "endpoint_id", "method", "path_pattern", "total_calls", "error_count",
        service_name(F.col("service_name"), F.col("host")).alias("target"),
    )
    named = consumers.select("endpoint_id", consumer_node_name(F.col("consumer")).alias("source"))
    return named.join(totals, "endpoint_id")


def inventory_edges(endpoints: DataFrame, consumers: DataFrame) -> DataFrame:
    return _calls(endpoints, consumers).groupBy("source", "target").agg(
        F.sum("total_calls").alias("call_count"),
        F.sum("error_count").alias("error_count"),
        F.sort_array(F.collect_set("method")).alias("methods"),
    )


def inventory_edge_paths(endpoints: DataFrame, consumers: DataFrame) -> DataFrame:
    return _calls(endpoints, consumers).select("source", "target", F.col("path_pattern").alias("path")).distinct()


def observed_edges(endpoints: DataFrame, consumers: DataFrame) -> DataFrame:
    """Edges that charge each consumer only its own calls (no double counting)."""
    target = endpoints.select("endpoint_id", "method", service_name(F.col("service_name"), F.col("host")).alias("target"))
    own = consumers.select("endpoint_id", consumer_node_name(F.col("consumer")).alias("source"), "calls", "errors")
    return own.join(target, "endpoint_id").groupBy("source", "target").agg(
        F.sum("calls").alias("call_count"),
        F.sum("errors").alias("error_count"),
        F.sort_array(F.collect_set("method")).alias("methods"),
    )


def inventory_nodes(endpoints: DataFrame, consumers: DataFrame) -> DataFrame:
    """Services with their endpoints and calls, plus consumers with the calls they make."""
    zero = F.lit(0).cast("bigint")
    services = endpoints.select(
        service_name(F.col("service_name"), F.col("host")).alias("name"),
        "host",
        F.lit(1).cast("bigint").alias("endpoints"),
        F.col("total_calls").alias("calls"),
        F.col("total_calls").alias("served"),
        F.col("error_count").alias("errors"),
    )
    callers = _calls(endpoints, consumers).select(
        F.col("source").alias("name"), F.lit(None).cast("string").alias("host"), zero.alias("endpoints"),
        F.col("total_calls").alias("calls"), zero.alias("served"), zero.alias("errors"),
    )
    merged = services.unionByName(callers).groupBy("name").agg(
        F.min("host").alias("host"),
        F.sum("endpoints").alias("endpoint_count"),
        F.sum("calls").alias("total_calls"),
        error_rate(F.sum("errors"), F.sum("served")).alias("error_rate"),
    )
    return merged.select(
        "name", F.lit("service").alias("node_type"), "host", "endpoint_count", "total_calls", "error_rate",
        F.lit(None).cast("string").alias("risk_level"),
    )


def _party_name() -> Column:
    return F.when(F.col("provider_name") != UNKNOWN_PROVIDER, F.col("provider_name")).otherwise(F.col("host"))


def _last_party(columns: list[str]) -> Column:
    """Hosts of one provider overwrite each other in order of falling calls: the last one stays."""
    return F.min(F.struct(F.col("total_calls"), F.col("host"), *columns))


def egress_nodes(parties: DataFrame, callers: DataFrame) -> DataFrame:
    kept = parties.groupBy(_party_name().alias("name")).agg(_last_party(["error_rate", "risk_level"]).alias("p"))
    thirds = kept.select(
        "name", F.lit("third_party").alias("node_type"), "p.host", F.lit(0).cast("bigint").alias("endpoint_count"),
        "p.total_calls", "p.error_rate", "p.risk_level",
    )
    names = callers.select(consumer_node_name(F.col("caller")).alias("name")).distinct()
    plain = names.join(thirds, "name", "left_anti").select(
        "name", F.lit("service").alias("node_type"), F.lit(None).cast("string").alias("host"),
        F.lit(0).cast("bigint").alias("endpoint_count"), F.lit(0).cast("bigint").alias("total_calls"),
        F.lit(0.0).alias("error_rate"), F.lit(None).cast("string").alias("risk_level"),
    )
    return thirds.unionByName(plain)


def egress_edges(parties: DataFrame, callers: DataFrame) -> DataFrame:
    """Caller -> third party; the edge carries the totals of the party host kept last."""
    joined = callers.select("host", consumer_node_name(F.col("caller")).alias("source")).join(parties, "host")
    grouped = joined.groupBy("source", _party_name().alias("target"))
    kept = grouped.agg(_last_party(["error_count", "methods"]).alias("p"))
    return kept.select(
        "source", "target", F.col("p.total_calls").alias("call_count"), "p.error_count", "p.methods"
    )


def combine_nodes(inventory: DataFrame, egress: DataFrame) -> DataFrame:
    """Egress added to an inventory graph: existing nodes keep their type, third parties take
    over the egress totals."""
    i, e = inventory.alias("i"), egress.alias("e")
    both = i.join(e, "name", "full")
    third = F.coalesce(F.col("e.node_type") == "third_party", F.lit(False))

    def pick(name: str) -> Column:
        return F.when(third | F.col("i.node_type").isNull(), F.col(f"e.{name}")).otherwise(F.col(f"i.{name}"))

    return both.select(
        "name",
        F.coalesce("i.node_type", "e.node_type").alias("node_type"),
        F.when(F.col("i.node_type").isNotNull(), F.col("i.host")).otherwise(F.col("e.host")).alias("host"),
        F.coalesce("i.endpoint_count", "e.endpoint_count").alias("endpoint_count"),
        pick("total_calls").alias("total_calls"),
        pick("error_rate").alias("error_rate"),
        F.col("e.risk_level").alias("risk_level"),
    )


def combine_edges(inventory: DataFrame, egress: DataFrame) -> DataFrame:
    """An egress edge replaces an inventory edge between the same two nodes."""
    kept = inventory.join(egress.select("source", "target"), ["source", "target"], "left_anti")
    return kept.unionByName(egress)


# ── Analysis ──


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    connected = edges.select(F.explode(F.array("source", "target")).alias("name"))
    return nodes.join(connected, "name", "left_anti")


def connected_names(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct()


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("in_degree"))


def critical_services(nodes: DataFrame, edges: DataFrame, limit: int = CRITICAL_LIMIT) -> DataFrame:
    return nodes.join(in_degree(edges), "name").orderBy(F.desc("in_degree"), "name").limit(limit)


#: Rounds that are kept as tables of their own before they are merged into one.
MERGE_ROUNDS = 8


def _reach(frontier: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Semi-naive reverse closure of ``frontier(*key, node)``: ``(*key, node, depth)``.

    It ends by itself, as each round must find rows never seen before.  Every round is written to
    the shared folder and finished rounds are merged every few rounds, so the plan is as large at
    any depth; a lost executor costs one round at most, and each join is planned from the measured
    size of the frontier.
    """
    callers = edges.select(F.col("target").alias("node"), F.col("source").alias("caller"))
    last = materialize(frontier.withColumn("depth", F.lit(0)), "reach")
    found, depth = [last], 0
    while True:
        depth += 1
        seen = union_all(found).select(*key, "node")
        step = last.select(*key, "node").join(callers, "node").select(*key, F.col("caller").alias("node"))
        fresh = step.distinct().join(seen, [*key, "node"], "left_anti").withColumn("depth", F.lit(depth))
        last = materialize(fresh, "reach")
        if last.isEmpty():
            return union_all(found)
        found.append(last)
        if len(found) > MERGE_ROUNDS:
            found = [materialize(union_all(found), "reach-merged")]


def blast_radius(nodes: DataFrame, edges: DataFrame, service: str) -> DataFrame:
    """Everything that calls ``service`` directly or through others, with its distance.

    No rows when the service is not in the graph or nobody depends on it.
    """
    start = nodes.filter(F.col("name") == service).select(F.col("name").alias("node"))
    links = materialize(edges.select("source", "target").distinct(), "edges")
    reached = _reach(start, links, [])
    return reached.filter("depth > 0").select(F.col("node").alias("affected"), "depth")


def blast_summary(radius: DataFrame, service: str) -> DataFrame:
    return radius.agg(
        F.lit(service).alias("service"),
        F.count("*").alias("affected_count"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )


def affected_counts(edges: DataFrame) -> DataFrame:
    """Blast-radius size of every called node: ``(name, affected_count)``.

    Closure rows exist only between *called* nodes (services).  Pure callers, usually the vast
    majority, are counted through groups: callers with exactly the same set of targets form one
    group with a weight.  Sets are grouped by size and hash; where the members of a group have more
    different targets than one set holds, the hash has failed and each of them is a group.
    """
    links = materialize(edges.select("source", "target").distinct().filter("source <> target"), "edges")
    called = links.select(F.col("target").alias("node")).distinct()
    inner = links.join(called.withColumnRenamed("node", "source"), "source", "left_semi")
    leaves = links.join(called.withColumnRenamed("node", "source"), "source", "left_anti")

    start = called.select(F.col("node").alias("root"), "node")
    closure = _reach(start, inner, ["root"]).select("root", "node")

    sets = leaves.groupBy("source").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("target")).alias("hash"))
    sets = materialize(sets, "caller-sets")
    members = leaves.join(sets, "source").select("size", "hash", "target").distinct()
    true = members.groupBy("size", "hash").agg(F.count("*").alias("targets")).filter("targets = size")
    alike = sets.join(true, ["size", "hash"], "left").withColumn("own", F.when(F.col("targets").isNull(), F.col("source")))
    groups = alike.groupBy("size", "hash", "own").agg(F.min("source").alias("source"), F.count("*").alias("weight"))
    targets = leaves.join(groups.select("source", "weight"), "source")  # one representative each
    hit = closure.join(targets.select(F.col("target").alias("node"), "source", "weight"), "node")
    outer = hit.select("root", "source", "weight").distinct().groupBy("root").agg(F.sum("weight").alias("callers"))
    inside = closure.groupBy("root").agg((F.count("*") - 1).alias("services"))
    return inside.join(outer, "root", "left").select(
        F.col("root").alias("name"), (F.col("services") + F.coalesce("callers", F.lit(0))).alias("affected_count")
    )


def single_points_of_failure(nodes: DataFrame, edges: DataFrame, share: float = SPOF_SHARE) -> DataFrame:
    """Nodes whose failure affects more than ``share`` of all nodes.

    Nodes nobody calls affect nothing, so only called nodes can qualify.
    """
    total = nodes.count()
    counts = affected_counts(edges)
    counts = counts.join(nodes.select("name"), "name", "left_semi")
    hits = counts.filter(F.col("affected_count") > F.lit(total) * share)
    percentage = F.bround(F.col("affected_count") / F.lit(max(total, 1)) * 100, 1)
    return hits.select(
        F.col("name").alias("service"), "affected_count", percentage.alias("affected_percentage")
    ).orderBy(F.desc("affected_count"), "service")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.select(F.col("node_type").alias("kind")).unionByName(edges.select(F.lit("edge").alias("kind")))
    return kinds.agg(
        F.count_if(F.col("kind") != "edge").alias("total_nodes"),
        F.count_if(F.col("kind") == "edge").alias("total_edges"),
        F.count_if(F.col("kind") == "service").alias("services"),
        F.count_if(F.col("kind") == "third_party").alias("third_parties"),
    )


# ── Exports ──


def drawn_size(calls: Column) -> Column:
    return F.greatest(F.lit(5), F.least(F.lit(50), F.floor(calls / 10) + 5))


def force_nodes(nodes: DataFrame) -> DataFrame:
    """Node rows of a force-directed drawing: group code and clamped size."""
    kind = F.col("node_type")
    group = F.when(kind == "service", 1).when(kind == "api_endpoint", 2).when(kind == "third_party", 3).otherwise(0)
    size = drawn_size(F.col("total_calls"))
    return nodes.select(
        F.col("name").alias("id"), group.alias("group"), kind.alias("type"), F.col("total_calls").alias("calls"),
        size.cast("bigint").alias("size"),
    )


def force_links(edges: DataFrame) -> DataFrame:
    width = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("call_count") / 100) + 1))
    return edges.select("source", "target", F.col("call_count").alias("value"), width.cast("bigint").alias("width"))


def _mermaid_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The diagram as ordered rows ``(section, sort_key, line)``: head, nodes, edges."""
    indent, ident = F.lit("    "), _mermaid_id(F.col("name"))
    kind = F.col("node_type")
    shape = (
        F.when(kind == "third_party", F.concat(indent, ident, F.lit("("), "name", F.lit(")")))
        .when(kind == "api_endpoint", F.concat(indent, ident, F.lit("{{"), "name", F.lit("}}")))
        .otherwise(F.concat(indent, ident, F.lit("["), "name", F.lit("]")))
    )
    arrow = F.concat(
        indent, _mermaid_id(F.col("source")), F.lit(" -->|"), F.col("call_count").cast("string"),
        F.lit(" calls| "), _mermaid_id(F.col("target")),
    )
    head = nodes.sparkSession.range(1).select(
        F.lit(0).alias("section"), F.lit("").alias("sort_key"), F.lit("graph LR").alias("line")
    )
    body = nodes.select(F.lit(1).alias("section"), F.col("name").alias("sort_key"), shape.alias("line"))
    tail = edges.select(
        F.lit(2).alias("section"), F.concat_ws("\n", "source", "target").alias("sort_key"), arrow.alias("line")
    )
    return head.unionByName(body).unionByName(tail).orderBy("section", "sort_key")


def export_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("error_rate", F.bround("error_rate", 3))


def export_edges(edges: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    rate = error_rate(F.col("error_count"), F.col("call_count"))
    out = edges.withColumn("error_rate", F.bround(rate, 3))
    return out if samples is None else out.join(samples, ["source", "target"], "left")
