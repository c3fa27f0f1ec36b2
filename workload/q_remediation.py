"""Generated rules and documents: J and parts of D, E, G."""

from pyspark.sql import functions as F

from routelens.operators import remediation
from routelens.plans.shared import materialize
from workload import views
from workload.q_inventory import classified
from workload.registry import query


def shadow(spark, d):
    return classified(spark, d).filter("status = 'shadow'")


_SHADOW = """(SELECT *, row_number() OVER (ORDER BY method, path_pattern, endpoint_id) - 1 AS i,
    regexp_replace(path_pattern, '\\{[^}]+\\}', '[^/]+', 'g') AS rx FROM ep WHERE status = 'shadow')"""
_TITLE = "array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"
_VERSION = "regexp_matches({x}, '^(v1|v2|v3|api)')"


def _title(x: str) -> str:
    return _TITLE.replace("{x}", x)


_SEGMENTS = "string_split(trim(path_pattern, '/'), '/')"
_OPERATION_ID = f"""lower(method) || array_to_string(list_transform(list_filter({_SEGMENTS}, lambda s: starts_with(s, '{{') OR NOT {_VERSION.replace('{x}', 's')}),
    lambda s: CASE WHEN starts_with(s, '{{') THEN 'By' || {_title("trim(s, '{}')")} ELSE {_title("replace(s, '-', '_')")} END), '')"""
_TAG = _title(f"translate(list_filter({_SEGMENTS}, lambda s: NOT ({_VERSION.replace('{x}', 's')} OR starts_with(s, '{{')))[1], '_-', '  ')")


@query("e6_rule_numbers", f"SELECT endpoint_id, 900000 + i AS rule_id, 100 + i AS priority FROM {_SHADOW}")
def _(spark, d):
    rows = remediation.numbered(shadow(spark, d))
    return rows.select("endpoint_id", (F.col("i") + 900000).alias("rule_id"), (F.col("i") + 100).alias("priority"))


@query(
    "j1_nginx_rules",
    f"""SELECT endpoint_id, '# Shadow API: ' || method || ' ' || path_pattern || chr(10) || '# Calls: ' || total_calls || ', First seen: ' ||
    strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') || chr(10) || 'location ~ ^' || rx || '$ {{' || chr(10) || '    if ($request_method = ' || method || ') {{' ||
    chr(10) || '        deny;' || chr(10) || '    }}' || chr(10) || '}}' AS block FROM {_SHADOW}""",
)
def _(spark, d):
    return remediation.nginx_blocks(shadow(spark, d)).select("endpoint_id", "block")


_STATEMENTS = (
    """[{"ByteMatchStatement":{"FieldToMatch":{"Method":{}},"PositionalConstraint":"EXACTLY","SearchString":"' || method || '","""
    """"TextTransformations":[{"Priority":0,"Type":"NONE"}]}},{"RegexPatternSetReferenceStatement":{"ARN":"PLACEHOLDER_ARN","""
    """"FieldToMatch":{"UriPath":{}},"TextTransformations":[{"Priority":0,"Type":"NONE"}]}}]"""
)


@query(
    "j2_waf_rules",
    f"""SELECT endpoint_id, 100 + i AS priority, '{{"Name":"BlockShadowAPI_' || i || '","Priority":' || (100 + i) || ',"Statement":{{"AndStatement":{{"Statements":{_STATEMENTS}}}}},"Action":{{"Block":{{}}}},"VisibilityConfig":{{"SampledRequestsEnabled":true,"CloudWatchMetricsEnabled":true,"MetricName":"BlockShadowAPI_' ||
    method || '_' || trim(regexp_replace(path_pattern, '[^A-Za-z0-9]', '_', 'g'), '_') || '"}}}}' AS rule FROM {_SHADOW}""",
)
def _(spark, d):
    return remediation.aws_waf_rules(shadow(spark, d))


@query(
    "j3_modsecurity_rules",
    f"""SELECT endpoint_id, 900000 + i AS rule_id, 'SecRule REQUEST_URI "@rx ^' || rx || '$" "id:' || (900000 + i) || ',phase:1,deny,status:403,msg:''routelens: Blocked shadow API ' ||
    method || ' ' || path_pattern || ''',chain"' || chr(10) || '    SecRule REQUEST_METHOD "@streq ' || method || '" ""' AS rule FROM {_SHADOW}""",
)
def _(spark, d):
    return remediation.modsecurity_rules(shadow(spark, d))


# ── Whole documents ──

_RULER = "'# ═══════════════════════════════════════════════'"


@query(
    "j1_nginx_document",
    f"""SELECT 0 AS section, {_RULER} || chr(10) || '# routelens — Auto-Generated Shadow API Block Rules' || chr(10) || '# Generated: 2024-01-31 00:00:00' AS line
    UNION ALL SELECT 1, '# Endpoints: ' || count(*) || chr(10) || {_RULER} || chr(10) FROM {_SHADOW}
    UNION ALL SELECT 2, '# Shadow API: ' || method || ' ' || path_pattern || chr(10) || '# Calls: ' || total_calls || ', First seen: ' ||
    strftime(first_seen, '%Y-%m-%d %H:%M:%S.%f') || chr(10) || 'location ~ ^' || rx || '$ {{' || chr(10) || '    if ($request_method = ' || method || ') {{' ||
    chr(10) || '        deny;' || chr(10) || '    }}' || chr(10) || '}}' || chr(10) FROM {_SHADOW}""",
)
def _(spark, d):
    return remediation.nginx_document(materialize(shadow(spark, d), "shadow"), views.AS_OF).select("section", "line")


@query(
    "j2_waf_document",
    f"""SELECT 0 AS section, '{{"_comment":"Generated by routelens at 2024-01-31 00:00:00","Name":"routelens-ShadowAPIBlockRules","Scope":"REGIONAL","DefaultAction":{{"Allow":{{}}}},"Rules":[' AS line
    UNION ALL SELECT 1, CASE WHEN i > 0 THEN ',' ELSE '' END || '{{"Name":"BlockShadowAPI_' || i || '","Priority":' || (100 + i) || ',"Statement":{{"AndStatement":{{"Statements":{_STATEMENTS}}}}},"Action":{{"Block":{{}}}},"VisibilityConfig":{{"SampledRequestsEnabled":true,"CloudWatchMetricsEnabled":true,"MetricName":"BlockShadowAPI_' ||
    method || '_' || trim(regexp_replace(path_pattern, '[^A-Za-z0-9]', '_', 'g'), '_') || '"}}}}' FROM {_SHADOW}
    UNION ALL SELECT 2, '],"VisibilityConfig":{{"SampledRequestsEnabled":true,"CloudWatchMetricsEnabled":true,"MetricName":"routelensShadowAPIRules"}}}}'""",
)
def _(spark, d):
    return remediation.aws_waf_document(materialize(shadow(spark, d), "shadow"), views.AS_OF).select("section", "line")


@query(
    "j3_modsecurity_document",
    f"""SELECT 0 AS section, {_RULER} || chr(10) || '# routelens — ModSecurity Shadow API Block Rules' || chr(10) || '# Generated: 2024-01-31 00:00:00' || chr(10) || {_RULER} || chr(10) AS line
    UNION ALL SELECT 1, 'SecRule REQUEST_URI "@rx ^' || rx || '$" "id:' || (900000 + i) || ',phase:1,deny,status:403,msg:''routelens: Blocked shadow API ' ||
    method || ' ' || path_pattern || ''',chain"' || chr(10) || '    SecRule REQUEST_METHOD "@streq ' || method || '" ""' || chr(10) FROM {_SHADOW}""",
)
def _(spark, d):
    return remediation.modsecurity_document(materialize(shadow(spark, d), "shadow"), views.AS_OF).select("section", "line")


_DESCRIPTION = """concat_ws(chr(10), '**Auto-discovered by routelens**' || chr(10), '- **Status:** ' || status, '- **Total calls observed:** ' || total_calls,
    '- **Error rate:** ' || printf('%.1f', CASE WHEN total_calls > 0 THEN error_count / total_calls ELSE 0 END * 100) || '%', '- **Consumers:** ' || consumer_count,
    '- **First seen:** ' || strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%f'), '- **Last seen:** ' || strftime(last_seen, '%Y-%m-%dT%H:%M:%S.%f'),
    '- **Avg latency:** ' || printf('%.0f', avg_ms) || 'ms', chr(10) || '> Review this endpoint and replace this auto-generated documentation.')"""
_RESPONSES = """'{"' || CASE method WHEN 'POST' THEN '201' WHEN 'DELETE' THEN '204' ELSE '200' END || '":{"description":"Successful response (inferred from traffic)"}' ||
    CASE WHEN error_count > 0 AND error_count / total_calls > 0.5 THEN ',"500":{"description":"Server error (high error rate observed)"}'
    WHEN error_count > 0 THEN ',"400":{"description":"Client error (errors observed in traffic)"}' ELSE '' END ||
    CASE WHEN list_contains(auth, 'none') AND len(auth) > 1 THEN ',"401":{"description":"Authentication required"}' ELSE '' END || '}'"""
_SECURITY = """coalesce(nullif('[' || array_to_string(list_transform(list_filter(auth, lambda a: a IN ('api_key', 'basic', 'bearer')), lambda a: '{"' ||
    CASE a WHEN 'api_key' THEN 'apiKeyAuth' WHEN 'basic' THEN 'basicAuth' ELSE 'bearerAuth' END || '":[]}'), ',') || ']', '[]'), '[{}]')"""
_PARAMETERS = r"""array_to_string(list_transform(regexp_extract_all(path_pattern, '\{(\w+)\}', 1), lambda n: '{"name":"' || n ||
    '","in":"path","required":true,"schema":{"type":"string"},"description":"Auto-detected path parameter: ' || n || '"}'), ',')"""
_WHOLE = (
    """'{"summary":"[Auto-discovered] ' || method || ' ' || path_pattern || '","description":' || CAST(to_json(""" + _DESCRIPTION + """) AS VARCHAR) || ',"responses":' || """
    + _RESPONSES + """ || CASE WHEN status = 'deprecated' THEN ',"deprecated":true' ELSE '' END || coalesce(',"tags":["' || """ + _TAG + """ || '"]', '') ||
    ',"operationId":"' || """ + _OPERATION_ID + """ || '"' || CASE WHEN contains(path_pattern, '{') THEN ',"parameters":[' || """ + _PARAMETERS + """ || ']' ELSE '' END ||
    ',"security":' || """ + _SECURITY + """ || '}'"""
)
_ITEMS = (
    """(SELECT path_pattern, '{' || string_agg(member, ',' ORDER BY member) || '}' AS path_item FROM (SELECT path_pattern, '"' || lower(method) || '":' || op AS member
    FROM (SELECT *, """ + _WHOLE + """ AS op, row_number() OVER (PARTITION BY path_pattern, lower(method) ORDER BY status DESC, endpoint_id DESC) AS f FROM @source) WHERE f = 1) GROUP BY path_pattern)"""
)
_SCHEMES = """(SELECT CASE a WHEN 'bearer' THEN 'bearerAuth' WHEN 'api_key' THEN 'apiKeyAuth' ELSE 'basicAuth' END AS scheme, CASE a
    WHEN 'bearer' THEN '{"type":"http","scheme":"bearer","bearerFormat":"JWT","description":"Inferred from observed Bearer tokens in traffic"}'
    WHEN 'api_key' THEN '{"type":"apiKey","in":"header","name":"X-API-Key","description":"Inferred from observed API key headers"}'
    ELSE '{"type":"http","scheme":"basic","description":"Inferred from observed Basic auth headers"}' END AS definition
    FROM (SELECT DISTINCT unnest(auth) AS a FROM ep) WHERE a IN ('bearer', 'api_key', 'basic'))"""


def _listed(section: int, key: str, text: str, source: str) -> str:
    return f"SELECT {section}, CASE WHEN row_number() OVER (ORDER BY {key}) > 1 THEN ',' ELSE '' END || {text} FROM {source}"


@query(
    "j4_openapi_document",
    " UNION ALL ".join(
        [
            """SELECT 0 AS section, '{"openapi":"3.0.3","info":{"title":"Auto-Generated API Spec","version":"1.0.0","description":"Auto-generated by routelens from observed traffic. Generated: 2024-01-31 00:00:00."},"components":{"securitySchemes":{' AS line""",
            _listed(1, "scheme", """'"' || scheme || '":' || definition""", _SCHEMES),
            """SELECT 2, '}},"servers":['""",
            _listed(3, "host", """'{"url":"https://' || host || '"}'""", "(SELECT DISTINCT host FROM ep WHERE host <> '')"),
            """SELECT 4, '],"paths":{'""",
            _listed(5, "path_pattern", """'"' || path_pattern || '":' || path_item""", _ITEMS.replace("@source", "ep")),
            "SELECT 6, '}}'",
        ]
    ),
)
def _(spark, d):
    rows = materialize(classified(spark, d), "endpoints")
    return remediation.openapi_lines(rows, views.AS_OF).select("section", "line")


@query("j5_undocumented_paths", f"SELECT path_pattern, path_item FROM {_ITEMS.replace('@source', '(SELECT * FROM ep WHERE NOT declared)')}")
def _(spark, d):
    return remediation.path_items(remediation.undocumented(classified(spark, d)))


def _operation(field: str):
    return F.get_json_object("operation", f"$.{field}")


@query(
    "j6_operations",
    f"""SELECT endpoint_id, '[Auto-discovered] ' || method || ' ' || path_pattern AS summary, {_OPERATION_ID} AS operation_id,
    '["' || {_TAG} || '"]' AS tags, CASE WHEN status = 'deprecated' THEN 'true' END AS deprecated FROM ep""",
)
def _(spark, d):
    return remediation.operations(classified(spark, d)).select(
        "endpoint_id", _operation("summary").alias("summary"), _operation("operationId").alias("operation_id"),
        _operation("tags").alias("tags"), _operation("deprecated").alias("deprecated"),
    )


@query(
    "j7_descriptions",
    """SELECT endpoint_id, concat_ws(chr(10), '**Auto-discovered by routelens**' || chr(10), '- **Status:** ' || status, '- **Total calls observed:** ' || total_calls,
    '- **Error rate:** ' || printf('%.1f', CASE WHEN total_calls > 0 THEN error_count / total_calls ELSE 0 END * 100) || '%', '- **Consumers:** ' || consumer_count,
    '- **First seen:** ' || strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%f'), '- **Last seen:** ' || strftime(last_seen, '%Y-%m-%dT%H:%M:%S.%f'),
    '- **Avg latency:** ' || printf('%.0f', avg_ms) || 'ms', chr(10) || '> Review this endpoint and replace this auto-generated documentation.') AS description FROM ep""",
)
def _(spark, d):
    return remediation.operations(classified(spark, d)).select("endpoint_id", _operation("description").alias("description"))


@query("j8_responses", f"SELECT endpoint_id, {_RESPONSES} AS responses FROM ep")
def _(spark, d):
    return remediation.operations(classified(spark, d)).select("endpoint_id", _operation("responses").alias("responses"))


@query(
    "j9_security",
    """SELECT endpoint_id, '[' || CASE WHEN len(found) = 0 THEN '{}' ELSE array_to_string(found, ',') END || ']' AS security FROM (SELECT endpoint_id,
    list_transform(list_filter(auth, lambda a: a IN ('api_key', 'basic', 'bearer')), lambda a: '{"' || CASE a WHEN 'api_key' THEN 'apiKeyAuth' WHEN 'basic'
    THEN 'basicAuth' ELSE 'bearerAuth' END || '":[]}') AS found FROM ep)""",
)
def _(spark, d):
    return remediation.operations(classified(spark, d)).select("endpoint_id", _operation("security").alias("security"))


@query("j10_security_schemes", f"SELECT scheme, definition FROM {_SCHEMES}")
def _(spark, d):
    return remediation.security_schemes(classified(spark, d))


@query("j11_path_parameters", "SELECT path_pattern, array_to_string(regexp_extract_all(path_pattern, '\\{(\\w+)\\}', 1), ',') AS parameters FROM ep GROUP BY path_pattern")
def _(spark, d):
    names = F.transform(remediation.path_parameters(F.col("path_pattern")), lambda p: p["name"])
    patterns = views.traffic(spark, d).select("path_pattern").union(views.spec_rows(spark, d).select("path")).distinct()
    return patterns.select("path_pattern", F.array_join(names, ",").alias("parameters"))


_PATHS = "(SELECT path AS path_pattern, 'GET' AS method FROM rt UNION SELECT regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), 'GET' FROM pages)"


def _paths(spark, d):
    from routelens.functions.paths import url_path

    urls = views.table(spark, d, "pages").select(url_path(F.col("url")).alias("path"))
    return views.raw_traffic(spark, d).select("path").union(urls).distinct().withColumnRenamed("path", "path_pattern")


@query("j12_tags", f"SELECT path_pattern, {_TAG} AS tag FROM {_PATHS}")
def _(spark, d):
    return _paths(spark, d).select("path_pattern", remediation.tag(F.col("path_pattern")).alias("tag"))


@query("j13_path_regex", "SELECT path_pattern, regexp_replace(path_pattern, '\\{[^}]+\\}', '[^/]+', 'g') AS regex FROM ep GROUP BY path_pattern")
def _(spark, d):
    rows = classified(spark, d).select("path_pattern").distinct()
    return rows.select("path_pattern", remediation.path_regex(F.col("path_pattern")).alias("regex"))


@query("j14_metric_names", f"SELECT path_pattern, trim(regexp_replace(path_pattern, '[^A-Za-z0-9]', '_', 'g'), '_') AS metric FROM {_PATHS}")
def _(spark, d):
    return _paths(spark, d).select("path_pattern", remediation.metric_name(F.col("path_pattern")).alias("metric"))


@query("j15_operation_ids", f"SELECT path_pattern, {_OPERATION_ID} AS operation_id FROM {_PATHS}")
def _(spark, d):
    return _paths(spark, d).select("path_pattern", remediation.operation_id(F.lit("GET"), F.col("path_pattern")).alias("operation_id"))


@query(
    "d31_auth_and_hosts",
    "SELECT 'auth' AS kind, a AS name FROM (SELECT DISTINCT unnest(auth) AS a FROM ep) UNION ALL SELECT 'server', 'https://' || host FROM ep WHERE host <> '' GROUP BY host",
)
def _(spark, d):
    rows = classified(spark, d)
    auth = rows.select(F.lit("auth").alias("kind"), F.explode("auth_methods_seen").alias("name")).distinct()
    return auth.unionByName(remediation.servers(rows).select(F.lit("server").alias("kind"), F.col("url").alias("name")))


@query("d32_path_groups", "SELECT path_pattern, string_agg(DISTINCT lower(method), ',' ORDER BY lower(method)) AS verbs FROM ep GROUP BY path_pattern")
def _(spark, d):
    verbs = F.sort_array(F.map_keys(F.from_json("path_item", "map<string,string>")))
    return remediation.path_items(classified(spark, d)).select("path_pattern", F.array_join(verbs, ",").alias("verbs"))


@query("g5_union_of_auth", "SELECT DISTINCT unnest(auth) AS auth FROM ep")
def _(spark, d):
    return classified(spark, d).select(F.explode("auth_methods_seen").alias("auth")).distinct()
