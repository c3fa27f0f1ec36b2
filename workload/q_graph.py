"""Dependency graph: I and parts of B, C, D, F, G."""

from pyspark.sql import functions as F

from routelens.functions import paths
from routelens.operators import egress, graph, inventory
from routelens.plans.shared import materialize
from workload import views
from workload.registry import joined, query, r6


def _state(spark, d):
    """Endpoints and their consumers, both from one written state table."""
    state = materialize(inventory.endpoint_parts(views.traffic(spark, d)), "parts")
    return inventory.endpoints_from_parts(state), inventory.endpoint_consumers(state)


def nodes_edges(spark, d):
    state = _state(spark, d)
    return graph.inventory_nodes(*state), graph.inventory_edges(*state)


def _egress(spark, d):
    parts = materialize(egress.egress_parts(views.traffic(spark, d)), "egress")
    return egress.third_parties(parts), egress.third_party_callers(parts)


@query(
    "b17_consumer_names",
    """SELECT consumer, CASE WHEN starts_with(consumer, '10.') OR starts_with(consumer, '172.') OR starts_with(consumer, '192.168.')
    THEN 'internal-' || consumer ELSE consumer END AS name FROM cons GROUP BY consumer""",
)
def _(spark, d):
    consumers = inventory.endpoint_consumers(inventory.endpoint_parts(views.traffic(spark, d))).select("consumer").distinct()
    return consumers.select("consumer", paths.consumer_node_name(F.col("consumer")).alias("name"))


@query("c11_direct_callers", "SELECT source FROM edges WHERE target = 'svc-2'")
def _(spark, d):
    return nodes_edges(spark, d)[1].filter("target = 'svc-2'").select("source")


def _registered(spark, d, nodes):
    """Nodes of the graph and services that are only registered: suppliers, whom nobody calls."""
    names = views.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return nodes.select("name").unionByName(names).distinct()


@query("c12_orphans", "SELECT name FROM (SELECT name FROM nodes UNION SELECT s_name FROM supplier) EXCEPT (SELECT source FROM edges UNION SELECT target FROM edges)")
def _(spark, d):
    nodes, edges = nodes_edges(spark, d)
    return graph.orphans(_registered(spark, d, nodes), edges).select("name")


@query("c13_degree_of_nodes", "SELECT name, total_calls, count(*) AS in_degree FROM nodes JOIN edges ON target = name GROUP BY name, total_calls")
def _(spark, d):
    nodes, edges = nodes_edges(spark, d)
    return nodes.join(graph.in_degree(edges), "name").select("name", "total_calls", "in_degree")


_NODES = "SELECT name, host, endpoint_count, total_calls, round(error_rate + 1e-9, 6) AS error_rate FROM nodes"
_EDGES = "SELECT source, target, call_count, error_count, array_to_string(methods, ',') AS methods FROM edges"


def _edge_columns():
    return ["source", "target", "call_count", "error_count", joined("methods")]


@query("d25_graph_nodes", _NODES)
def _(spark, d):
    return nodes_edges(spark, d)[0].select("name", "host", "endpoint_count", "total_calls", r6("error_rate"))


@query("d26_graph_edges", _EDGES)
def _(spark, d):
    return nodes_edges(spark, d)[1].select(*_edge_columns())


@query(
    "d26_observed_edges",
    """SELECT source, target, sum(own_calls)::BIGINT AS call_count, sum(own_errors)::BIGINT AS error_count,
    array_to_string(list_sort(list(DISTINCT method)), ',') AS methods FROM calls GROUP BY source, target""",
)
def _(spark, d):
    return graph.observed_edges(*_state(spark, d)).select(*_edge_columns())


@query(
    "d27_egress_graph",
    """SELECT 'node' AS kind, name, NULL AS target, total_calls AS calls, round(error_rate + 1e-9, 6) AS rate, risk FROM enodes
    UNION ALL SELECT 'edge', source, target, call_count, round(error_count / call_count + 1e-9, 6), NULL FROM eedges""",
)
def _(spark, d):
    both = _egress(spark, d)
    nodes = graph.egress_nodes(*both).select(
        F.lit("node").alias("kind"), "name", F.lit(None).cast("string").alias("target"),
        F.col("total_calls").alias("calls"), r6("error_rate", "rate"), F.col("risk_level").alias("risk"),
    )
    edges = graph.egress_edges(*both).select(
        F.lit("edge").alias("kind"), F.col("source").alias("name"), "target", F.col("call_count").alias("calls"),
        r6(F.col("error_count") / F.col("call_count"), "rate"), F.lit(None).cast("string").alias("risk"),
    )
    return nodes.unionByName(edges)


@query("d28_in_degree", "SELECT target AS name, count(*) AS in_degree FROM edges GROUP BY target")
def _(spark, d):
    return graph.in_degree(nodes_edges(spark, d)[1])


def _combined(spark, d):
    state, out = _state(spark, d), _egress(spark, d)
    return (
        graph.combine_nodes(graph.inventory_nodes(*state), graph.egress_nodes(*out)),
        graph.combine_edges(graph.inventory_edges(*state), graph.egress_edges(*out)),
    )


_CNODES = """SELECT coalesce(i.name, e.name) AS name, CASE WHEN i.name IS NOT NULL THEN 'service' ELSE e.node_type END AS node_type,
    CASE WHEN i.name IS NULL OR e.node_type = 'third_party' THEN e.total_calls ELSE i.total_calls END AS total_calls
    FROM nodes i FULL JOIN enodes e ON i.name = e.name"""
_CEDGES = """SELECT source, target, call_count FROM eedges UNION ALL SELECT source, target, call_count FROM edges g
    WHERE NOT EXISTS (SELECT 1 FROM eedges e WHERE e.source = g.source AND e.target = g.target)"""


@query(
    "d29_graph_stats",
    f"""SELECT (SELECT count(*) FROM ({_CNODES})) AS total_nodes, (SELECT count(*) FROM ({_CEDGES})) AS total_edges,
    (SELECT count(*) FROM ({_CNODES}) WHERE node_type = 'service') AS services,
    (SELECT count(*) FROM ({_CNODES}) WHERE node_type = 'third_party') AS third_parties""",
)
def _(spark, d):
    return graph.graph_stats(*_combined(spark, d))


@query("g4_connected_nodes", "SELECT source AS name FROM edges UNION SELECT target FROM edges")
def _(spark, d):
    return graph.connected_names(nodes_edges(spark, d)[1])


@query(
    "i1_inventory_graph",
    "SELECT name, total_calls, round(error_rate + 1e-9, 6) AS error_rate, NULL AS target, NULL AS methods FROM nodes "
    "UNION ALL SELECT source, call_count, error_count, target, array_to_string(methods, ',') FROM edges",
)
def _(spark, d):
    nodes, edges = nodes_edges(spark, d)
    none = F.lit(None).cast("string")
    one = nodes.select("name", "total_calls", r6("error_rate"), none.alias("target"), none.alias("methods"))
    two = edges.select(
        F.col("source").alias("name"), F.col("call_count").alias("total_calls"), F.col("error_count").cast("double").alias("error_rate"), "target", joined("methods")
    )
    return one.unionByName(two)


@query(
    "i2_combined_graph",
    f"SELECT name, node_type, total_calls, NULL AS target FROM ({_CNODES}) UNION ALL SELECT source, 'edge', call_count, target FROM ({_CEDGES})",
)
def _(spark, d):
    nodes, edges = _combined(spark, d)
    return nodes.select("name", "node_type", "total_calls", F.lit(None).cast("string").alias("target")).unionByName(
        edges.select(F.col("source").alias("name"), F.lit("edge").alias("node_type"), F.col("call_count").alias("total_calls"), "target")
    )


_REACH = """/*recursive*/ /*with*/ reach AS (SELECT 'api.stripe.com' AS node, 0 AS depth UNION SELECT source, depth + 1 FROM reach JOIN edges ON target = node
    WHERE depth < 30) /*end*/ """


@query("i3_blast_radius", _REACH + "SELECT node AS affected, min(depth) AS depth FROM reach WHERE node <> 'api.stripe.com' GROUP BY node")
def _(spark, d):
    return graph.blast_radius(*nodes_edges(spark, d), "api.stripe.com")


@query(
    "i3_blast_summary",
    _REACH + """SELECT 'api.stripe.com' AS service, count(*) AS affected_count, max(depth) AS max_depth FROM
    (SELECT node, min(depth) AS depth FROM reach WHERE node <> 'api.stripe.com' GROUP BY node)""",
)
def _(spark, d):
    return graph.blast_summary(graph.blast_radius(*nodes_edges(spark, d), "api.stripe.com"), "api.stripe.com")


_SPOF = """/*recursive*/ /*with*/ pairs AS (SELECT target AS root, source AS node FROM edges UNION SELECT root, source FROM pairs JOIN edges ON target = node) /*end*/
    SELECT root AS service, count(*) AS affected_count, round_even(count(*) / (SELECT count(*) FROM nodes) * 100, 1) AS affected_percentage
    FROM pairs WHERE node <> root GROUP BY root HAVING count(*) > (SELECT count(*) FROM nodes) * 0.15"""


def _spof(spark, d):
    nodes, edges = nodes_edges(spark, d)
    # the widest radius of this small graph is 29 % of its nodes, so the share is lowered
    return graph.single_points_of_failure(materialize(nodes, "nodes"), edges, share=0.15)


@query("i4_single_points_of_failure", _SPOF)
def _(spark, d):
    return _spof(spark, d)


@query("f7_spof_by_affected", _SPOF + " ORDER BY affected_count DESC, service")
def _(spark, d):
    return _spof(spark, d)


@query(
    "i5_orphaned_services",
    f"SELECT name FROM (SELECT name FROM ({_CNODES}) UNION SELECT s_name FROM supplier) EXCEPT (SELECT source FROM ({_CEDGES}) UNION SELECT target FROM ({_CEDGES}))",
)
def _(spark, d):
    nodes, edges = _combined(spark, d)
    return graph.orphans(_registered(spark, d, nodes), edges).select("name")


_CRITICAL = "SELECT name, count(*) AS in_degree FROM nodes JOIN edges ON target = name GROUP BY name ORDER BY in_degree DESC, name LIMIT 10"


@query("i6_critical_services", _CRITICAL)
def _(spark, d):
    return graph.critical_services(*nodes_edges(spark, d)).select("name", "in_degree")


@query("f6_top_in_degree", _CRITICAL.replace("LIMIT 10", "LIMIT 3"))
def _(spark, d):
    return graph.critical_services(*nodes_edges(spark, d), limit=3).select("name", "in_degree")


@query(
    "i7_force_graph",
    """SELECT name AS id, 1 AS "group", total_calls AS calls, greatest(5, least(50, total_calls // 10 + 5))::BIGINT AS size, NULL AS target FROM nodes
    UNION ALL SELECT source, 0, call_count, greatest(1, least(10, call_count // 100 + 1))::BIGINT, target FROM edges""",
)
def _(spark, d):
    nodes, edges = nodes_edges(spark, d)
    drawn = graph.force_nodes(nodes).select("id", "group", "calls", "size", F.lit(None).cast("string").alias("target"))
    links = graph.force_links(edges).select(
        F.col("source").alias("id"), F.lit(0).alias("group"), F.col("value").alias("calls"), F.col("width").alias("size"), "target"
    )
    return drawn.unionByName(links)


@query(
    "i8_mermaid",
    """SELECT 'graph LR' AS line UNION ALL SELECT '    ' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') || CASE node_type WHEN 'third_party'
    THEN '(' || name || ')' ELSE '[' || name || ']' END FROM (""" + _CNODES + """) UNION ALL SELECT '    ' || regexp_replace(source, '[^A-Za-z0-9_]', '_', 'g') ||
    ' -->|' || call_count || ' calls| ' || regexp_replace(target, '[^A-Za-z0-9_]', '_', 'g') FROM (""" + _CEDGES + ")",
)
def _(spark, d):
    return graph.mermaid_lines(*_combined(spark, d)).select("line")


@query(
    "i9_graph_export",
    """SELECT e.source, e.target, call_count, array_to_string(methods, ',') AS methods, error_count, round_even(error_count / call_count, 3) AS error_rate,
    s.paths AS paths_sample FROM edges e JOIN (SELECT source, target, string_agg(path_pattern, ',' ORDER BY path_pattern) AS paths FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY path_pattern) AS f FROM (SELECT DISTINCT source, target, path_pattern FROM calls))
    WHERE f <= 5 GROUP BY source, target) s ON e.source = s.source AND e.target = s.target""",
)
def _(spark, d):
    state = _state(spark, d)
    samples = egress.path_samples(
        graph.inventory_edge_paths(*state), ["source", "target"], "path", graph.EDGE_PATH_SAMPLE
    )
    return graph.export_edges(graph.inventory_edges(*state), samples).select(
        "source", "target", "call_count", joined("methods"), "error_count", "error_rate", joined("paths_sample")
    )
