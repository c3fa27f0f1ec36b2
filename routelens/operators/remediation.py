"""Firewall rules and OpenAPI documents generated from the inventory.

Every artefact is rows: one text block, rule or path item per endpoint, ready to be written in
order by Spark.  Texts that name their generator use ``TOOL``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.functions.pytext import iso, percent, plain, title_words, whole
from routelens.operators.inventory import error_rate
from routelens.plans.shared import union_all, with_index

TOOL = "routelens"
# Number ranges of generated rules, and document texts, here and in the templates of rules,
# descriptions, responses and parameters below.
RULER = "# ═══════════════════════════════════════════════"
WAF_NAME, WAF_METRIC = f"{TOOL}-ShadowAPIBlockRules", f"{TOOL}ShadowAPIRules"
FIRST_RULE_ID = 900000
FIRST_PRIORITY = 100
SPEC_TITLE = "Auto-Generated API Spec"
UNDOCUMENTED_TITLE = "Undocumented APIs — Needs Review"
UNDOCUMENTED_DESCRIPTION = (
    "These endpoints were discovered through traffic analysis but are not declared in any existing "
    "OpenAPI spec. Please review and document them."
)
SUCCESS_CODES = {"GET": "200", "POST": "201", "PUT": "200", "PATCH": "200", "DELETE": "204"}
SECURITY_SCHEMES = {
    "bearer": (
        "bearerAuth",
        '{"type":"http","scheme":"bearer","bearerFormat":"JWT",'
        '"description":"Inferred from observed Bearer tokens in traffic"}',
    ),
    "api_key": (
        "apiKeyAuth",
        '{"type":"apiKey","in":"header","name":"X-API-Key","description":"Inferred from observed API key headers"}',
    ),
    "basic": (
        "basicAuth",
        '{"type":"http","scheme":"basic","description":"Inferred from observed Basic auth headers"}',
    ),
}
SKIPPED_SEGMENTS = ("v1", "v2", "v3", "api")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


# ── Expressions ──


def path_regex(pattern: Column) -> Column:
    """``/users/{id}`` -> ``/users/[^/]+``."""
    return F.regexp_replace(pattern, r"\{[^}]+\}", "[^/]+")


def metric_name(s: Column) -> Column:
    return F.btrim(F.regexp_replace(s, "[^A-Za-z0-9]", "_"), F.lit("_"))


def _segments(path: Column) -> Column:
    return F.split(F.btrim(path, F.lit("/")), "/")


def _is_version(segment: Column) -> Column:
    hit = F.lit(False)
    for prefix in SKIPPED_SEGMENTS:
        hit = hit | segment.startswith(prefix)
    return hit


def operation_id(method: Column, path: Column) -> Column:
    words = F.transform(
        F.filter(_segments(path), lambda p: p.startswith("{") | ~_is_version(p)),
        lambda p: F.when(
            p.startswith("{"), F.concat(F.lit("By"), title_words(F.btrim(p, F.lit("{}"))))
        ).otherwise(title_words(F.replace(p, F.lit("-"), F.lit("_")))),
    )
    return F.concat(F.lower(method), F.array_join(words, ""))


def tag(path: Column) -> Column:
    """Name of the first meaningful segment; NULL when there is none."""
    named = F.filter(_segments(path), lambda p: ~(_is_version(p) | p.startswith("{")))
    return title_words(F.translate(F.get(named, F.lit(0)), "_-", "  "))


def path_parameters(pattern: Column) -> Column:
    names = F.regexp_extract_all(pattern, F.lit(r"\{(\w+)\}"), F.lit(1))
    return F.transform(
        names,
        lambda n: F.struct(
            n.alias("name"),
            F.lit("path").alias("in"),
            F.lit(True).alias("required"),
            F.struct(F.lit("string").alias("type")).alias("schema"),
            F.concat(F.lit("Auto-detected path parameter: "), n).alias("description"),
        ),
    )


def operation_description() -> Column:
    rate = error_rate(F.col("error_count"), F.col("total_calls"))
    latency = F.col("avg_response_time_ms")
    return F.concat_ws(
        "\n",
        F.lit(f"**Auto-discovered by {TOOL}**\n"),
        _text("- **Status:** ", F.col("status")),
        _text("- **Total calls observed:** ", F.col("total_calls").cast("string")),
        _text("- **Error rate:** ", percent(rate, 1)),
        _text("- **Consumers:** ", F.col("consumer_count").cast("string")),
        _text("- **First seen:** ", iso(F.col("first_seen"))),  # concat_ws skips missing times
        _text("- **Last seen:** ", iso(F.col("last_seen"))),
        F.when(latency != 0, _text("- **Avg latency:** ", whole(latency), "ms")),
        F.lit("\n> Review this endpoint and replace this auto-generated documentation."),
    )


def responses() -> Column:
    success = F.lit("200")
    for verb, code in SUCCESS_CODES.items():
        success = F.when(F.col("method") == verb, code).otherwise(success)
    rate = error_rate(F.col("error_count"), F.col("total_calls"))
    failed = F.col("error_count") > 0
    auth = F.col("auth_methods_seen")

    def entry(code: Column | str, text: str) -> Column:
        key = F.lit(code) if isinstance(code, str) else code
        return F.struct(key.alias("key"), F.struct(F.lit(text).alias("description")).alias("value"))

    entries = F.array(
        entry(success, "Successful response (inferred from traffic)"),
        F.when(failed & (rate > 0.5), entry("500", "Server error (high error rate observed)")),
        F.when(failed & (rate <= 0.5), entry("400", "Client error (errors observed in traffic)")),
        F.when(F.array_contains(auth, "none") & (F.size(auth) > 1), entry("401", "Authentication required")),
    )
    return F.map_from_entries(F.array_compact(entries))


def security() -> Column:
    """Security requirements; one empty requirement when no credentials were seen."""
    empty = F.array().cast("array<string>")
    named = [
        F.when(F.array_contains("auth_methods_seen", auth), F.create_map(F.lit(scheme), empty))
        for auth, (scheme, _) in sorted(SECURITY_SCHEMES.items())
    ]
    found = F.array_compact(F.array(*named))
    return F.when(F.size(found) > 0, found).otherwise(
        F.array(F.create_map().cast("map<string,array<string>>"))
    )


def operation() -> Column:
    """The OpenAPI operation object of an endpoint row."""
    params, name = path_parameters(F.col("path_pattern")), tag(F.col("path_pattern"))
    return F.struct(
        _text("[Auto-discovered] ", F.col("method"), " ", F.col("path_pattern")).alias("summary"),
        operation_description().alias("description"),
        responses().alias("responses"),
        F.when(F.col("status") == "deprecated", F.lit(True)).alias("deprecated"),
        F.when(name.isNotNull(), F.array(name)).alias("tags"),
        operation_id(F.col("method"), F.col("path_pattern")).alias("operationId"),
        F.when(F.size(params) > 0, params).alias("parameters"),
        security().alias("security"),
    )


# ── Firewall rules ──


def nginx_blocks(endpoints: DataFrame, action: str = "deny") -> DataFrame:
    """One location block per endpoint, to be written in (method, path_pattern) order."""
    route = _text(F.col("method"), " ", F.col("path_pattern"))
    block = F.concat_ws(
        "\n",
        _text("# Shadow API: ", route),
        _text("# Calls: ", F.col("total_calls").cast("string"), ", First seen: ", plain(F.col("first_seen"))),
        _text("location ~ ^", path_regex(F.col("path_pattern")), "$ {"),
        _text("    if ($request_method = ", F.col("method"), ") {"),
        F.lit(f"        {action};"),
        F.lit("    }"),
        F.lit("}"),
    )
    return endpoints.select("endpoint_id", "method", "path_pattern", block.alias("block"))


def numbered(endpoints: DataFrame) -> DataFrame:
    """Endpoints with a running number ``i`` in (method, path_pattern) order."""
    return with_index(endpoints, ["method", "path_pattern", "endpoint_id"], "i")


def modsecurity_rules(endpoints: DataFrame) -> DataFrame:
    route = _text(F.col("method"), " ", F.col("path_pattern"))
    rule_id = F.col("i") + FIRST_RULE_ID
    rule = _text(
        'SecRule REQUEST_URI "@rx ^', path_regex(F.col("path_pattern")), '$" "id:', rule_id.cast("string"),
        f",phase:1,deny,status:403,msg:'{TOOL}: Blocked shadow API ", route, "',chain\"\n",
        '    SecRule REQUEST_METHOD "@streq ', F.col("method"), '" ""',
    )
    return numbered(endpoints).select("endpoint_id", rule_id.alias("rule_id"), rule.alias("rule"))


def aws_waf_rules(endpoints: DataFrame) -> DataFrame:
    """One rule JSON per endpoint, to be placed in the ``Rules`` list of a rule group."""
    nothing = F.create_map().cast("map<string,string>")
    plain_text = F.array(F.struct(F.lit(0).alias("Priority"), F.lit("NONE").alias("Type")))
    by_method = F.struct(
        F.struct(nothing.alias("Method")).alias("FieldToMatch"),
        F.lit("EXACTLY").alias("PositionalConstraint"),
        F.col("method").alias("SearchString"),
        plain_text.alias("TextTransformations"),
    )
    by_path = F.struct(
        F.lit("PLACEHOLDER_ARN").alias("ARN"),
        F.struct(nothing.alias("UriPath")).alias("FieldToMatch"),
        plain_text.alias("TextTransformations"),
    )
    statements = F.array(
        F.struct(by_method.alias("ByteMatchStatement"), F.lit(None).alias("RegexPatternSetReferenceStatement")),
        F.struct(F.lit(None).alias("ByteMatchStatement"), by_path.alias("RegexPatternSetReferenceStatement")),
    )
    rule = F.struct(
        F.concat(F.lit("BlockShadowAPI_"), F.col("i").cast("string")).alias("Name"),
        (F.col("i") + FIRST_PRIORITY).alias("Priority"),
        F.struct(F.struct(statements.alias("Statements")).alias("AndStatement")).alias("Statement"),
        F.struct(nothing.alias("Block")).alias("Action"),
        F.struct(
            F.lit(True).alias("SampledRequestsEnabled"),
            F.lit(True).alias("CloudWatchMetricsEnabled"),
            F.concat_ws("_", F.lit("BlockShadowAPI"), F.col("method"), metric_name(F.col("path_pattern"))).alias(
                "MetricName"
            ),
        ).alias("VisibilityConfig"),
    )
    return numbered(endpoints).select(
        "endpoint_id", (F.col("i") + FIRST_PRIORITY).alias("priority"), F.to_json(rule).alias("rule")
    )


def _fixed(spark, section: int, line: Column) -> DataFrame:
    return spark.range(1).select(F.lit(section).alias("section"), F.lit("").alias("sort_key"), line.alias("line"))


def _key(i: Column) -> Column:
    """A running number as a text that sorts like it."""
    return F.lpad(i.cast("string"), 19, "0")


def nginx_document(endpoints: DataFrame, as_of: str, action: str = "deny") -> DataFrame:
    """The whole nginx file as ordered lines ``(section, sort_key, line)``: head, then a block per endpoint."""
    spark = endpoints.sparkSession
    rows = numbered(endpoints)
    count = endpoints.agg(F.count("*").cast("string").alias("n")).select(
        F.lit(1).alias("section"), F.lit("").alias("sort_key"), _text("# Endpoints: ", F.col("n"), f"\n{RULER}\n").alias("line")
    )
    head = F.lit(f"{RULER}\n# {TOOL} — Auto-Generated Shadow API Block Rules\n# Generated: {as_of}")
    blocks = nginx_blocks(rows, action).select("endpoint_id", "block").join(rows.select("endpoint_id", "i"), "endpoint_id")
    body = blocks.select(F.lit(2).alias("section"), _key(F.col("i")).alias("sort_key"), F.concat("block", F.lit("\n")).alias("line"))
    return union_all([_fixed(spark, 0, head), count, body]).orderBy("section", "sort_key")


def modsecurity_document(endpoints: DataFrame, as_of: str) -> DataFrame:
    """The whole rule file as ordered lines ``(section, sort_key, line)``."""
    head = F.lit(f"{RULER}\n# {TOOL} — ModSecurity Shadow API Block Rules\n# Generated: {as_of}\n{RULER}\n")
    body = modsecurity_rules(endpoints).select(
        F.lit(1).alias("section"), _key(F.col("rule_id")).alias("sort_key"), F.concat("rule", F.lit("\n")).alias("line")
    )
    return union_all([_fixed(endpoints.sparkSession, 0, head), body]).orderBy("section", "sort_key")


def aws_waf_document(endpoints: DataFrame, as_of: str) -> DataFrame:
    """The whole rule group as ordered lines ``(section, sort_key, line)`` of one JSON document."""
    spark = endpoints.sparkSession
    head = (
        f'{{"_comment":"Generated by {TOOL} at {as_of}","Name":"{WAF_NAME}","Scope":"REGIONAL",'
        '"DefaultAction":{"Allow":{}},"Rules":['
    )
    tail = f'],"VisibilityConfig":{{"SampledRequestsEnabled":true,"CloudWatchMetricsEnabled":true,"MetricName":"{WAF_METRIC}"}}}}'
    rules = aws_waf_rules(endpoints).withColumn("key", _key(F.col("priority")))
    lines = [_fixed(spark, 0, F.lit(head)), _members(rules, 1, "key", F.col("rule")), _fixed(spark, 2, F.lit(tail))]
    return union_all(lines).orderBy("section", "sort_key")


# ── OpenAPI documents ──


def operations(endpoints: DataFrame) -> DataFrame:
    return endpoints.select("endpoint_id", "method", "path_pattern", F.to_json(operation()).alias("operation"))


def path_items(endpoints: DataFrame) -> DataFrame:
    """One row per path: its operations by verb.  Of equal (verb, path) on several hosts the last
    in (status, endpoint id) order stays."""
    one = endpoints.groupBy("path_pattern", F.lower("method").alias("verb")).agg(
        F.max(F.struct("status", "endpoint_id", F.to_json(operation()).alias("op"))).alias("kept")
    )
    member = F.concat(F.lit('"'), F.col("verb"), F.lit('":'), F.col("kept.op"))
    joined = F.array_join(F.sort_array(F.collect_list(member)), ",")
    return one.groupBy("path_pattern").agg(F.concat(F.lit("{"), joined, F.lit("}")).alias("path_item"))


def security_schemes(endpoints: DataFrame) -> DataFrame:
    """The scheme definitions needed for the authentication methods seen anywhere."""
    seen = endpoints.select(F.explode("auth_methods_seen").alias("auth")).distinct()
    name, definition = F.lit(None), F.lit(None)
    for auth, (scheme, body) in SECURITY_SCHEMES.items():
        name = F.when(F.col("auth") == auth, scheme).otherwise(name)
        definition = F.when(F.col("auth") == auth, body).otherwise(definition)
    return seen.select(name.alias("scheme"), definition.alias("definition")).filter("scheme is not null")


def servers(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter("host <> ''").select(F.concat(F.lit("https://"), "host").alias("url")).distinct()


def undocumented(endpoints: DataFrame) -> DataFrame:
    return endpoints.filter(~F.col("declared_in_spec"))


def _members(rows: DataFrame, section: int, key: str, text: Column) -> DataFrame:
    """Rows as comma-separated JSON members: all but the first in order start with a comma."""
    keyed = rows.select(F.col(key).alias("sort_key"), text.alias("text"))
    first = F.broadcast(keyed.agg(F.min("sort_key").alias("first")))  # one row
    joined = keyed.join(first, F.col("sort_key") == F.col("first"), "left")
    line = F.when(F.col("first").isNotNull(), F.col("text")).otherwise(F.concat(F.lit(","), "text"))
    return joined.select(F.lit(section).alias("section"), "sort_key", line.alias("line"))


def openapi_lines(
    endpoints: DataFrame, as_of: str, title: str = SPEC_TITLE, version: str = "1.0.0", description: str | None = None
) -> DataFrame:
    """A whole OpenAPI 3.0.3 document as ordered lines ``(section, sort_key, line)``.

    Written in this order the part files concatenate to one valid JSON document, so a document of
    any size is produced without ever being held in one place.
    """
    spark = endpoints.sparkSession
    text = description or f"Auto-generated by {TOOL} from observed traffic. Generated: {as_of}."

    def fixed(section: int, line: Column) -> DataFrame:
        return _fixed(spark, section, line)

    info = F.to_json(
        F.struct(F.lit(title).alias("title"), F.lit(version).alias("version"), F.lit(text).alias("description"))
    )

    def quote(c: str) -> Column:  # a JSON string literal
        return F.regexp_extract(F.to_json(F.array(c)), r"^\[([\s\S]*)\]$", 1)

    lines = [
        fixed(0, F.concat(F.lit('{"openapi":"3.0.3","info":'), info, F.lit(',"components":{"securitySchemes":{'))),
        _members(security_schemes(endpoints), 1, "scheme", F.concat(quote("scheme"), F.lit(":"), "definition")),
        fixed(2, F.lit('}},"servers":[')),
        _members(servers(endpoints), 3, "url", F.concat(F.lit('{"url":'), quote("url"), F.lit("}"))),
        fixed(4, F.lit('],"paths":{')),
        _members(path_items(endpoints), 5, "path_pattern", F.concat(quote("path_pattern"), F.lit(":"), "path_item")),
        fixed(6, F.lit("}}")),
    ]
    return union_all(lines).orderBy("section", "sort_key")
