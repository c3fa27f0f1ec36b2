"""K: the scalar functions, each over whole tables."""

from pyspark.sql import functions as F

from routelens.functions import auth, paths, pytext, times
from routelens.operators import anomaly, graph, inventory, network, remediation
from routelens.plans.shared import materialize
from routelens.sources import tables
from workload import views
from workload.registry import query, r6
from workload.sql import ts


@query(
    "k1_regex",
    """SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS replaced, regexp_extract(url, '/([a-z]+)/', 1) AS extracted,
    array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS found,
    trim(regexp_replace(url, '[^A-Za-z0-9]', '_', 'g'), '_') AS metric, regexp_replace(url, '\\{[^}]+\\}', '[^/]+', 'g') AS route FROM pages""",
)
def _(spark, d):
    url = F.col("url")
    return views.table(spark, d, "pages").select(
        "page_id", F.regexp_replace(url, "[^A-Za-z0-9_]", "_").alias("replaced"),
        F.regexp_extract(url, "/([a-z]+)/", 1).alias("extracted"),
        F.array_join(F.regexp_extract_all(url, F.lit("[0-9]+"), F.lit(0)), ",").alias("found"),
        remediation.metric_name(url).alias("metric"), remediation.path_regex(url).alias("route"),
    )


@query(
    "k2_strings",
    """SELECT o_orderkey, lower(o_orderpriority) AS low, upper(o_orderpriority) AS up, array_to_string(list_transform(
    regexp_extract_all(o_orderpriority, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '') AS title,
    starts_with(o_orderpriority, '1') AS first, ends_with(o_orderpriority, 'LOW') AS last, contains(o_orderpriority, '-') AS dash,
    string_split(o_orderpriority, '-')[1] AS head, replace(o_orderpriority, ' ', '_') AS joined, substr(o_orderpriority, 1, 4) AS cut FROM orders""",
)
def _(spark, d):
    c = F.col("o_orderpriority")
    return views.table(spark, d, "orders").select(
        "o_orderkey", F.lower(c).alias("low"), F.upper(c).alias("up"), pytext.title_words(c).alias("title"),
        c.startswith("1").alias("first"), c.endswith("LOW").alias("last"), c.contains("-").alias("dash"),
        F.get(F.split(c, "-"), F.lit(0)).alias("head"), F.replace(c, F.lit(" "), F.lit("_")).alias("joined"),
        F.substring(c, 1, 4).alias("cut"),
    )


@query("k3_like", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%CUSTOMER#%1_3%' OR c_mktsegment ILIKE '%CUSTOMER#%1_3%'")
def _(spark, d):
    rows = views.table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("path_pattern"), F.col("c_mktsegment").alias("host"), F.lit(None).cast("string").alias("service_name")
    )
    return inventory.search(rows, "CUSTOMER#%1_3").select("c_custkey")


@query(
    "k4_auth_detection",
    """SELECT doc_id, CASE WHEN contains(t, 'bearer ') THEN 'bearer' WHEN contains(t, 'apikey') OR contains(t, 'x-api-key') THEN 'api_key'
    WHEN contains(t, 'basic ') THEN 'basic' WHEN NOT contains(t, 'authorization') THEN 'none' ELSE 'unknown' END AS auth_method
    FROM (SELECT doc_id, lower(text) AS t FROM documents)""",
)
def _(spark, d):
    return views.table(spark, d, "documents").select("doc_id", auth.auth_from_header(F.col("text")).alias("auth_method"))


@query(
    "k5_authorizer_type",
    """SELECT conv_id, turn, CASE WHEN contains(t, 'cognito') OR contains(t, 'jwt') OR contains(t, 'token') THEN 'bearer' WHEN contains(t, 'iam') THEN 'api_key'
    WHEN t IN ('', 'none') THEN 'none' ELSE 'unknown' END AS auth_method FROM (SELECT *, lower(coalesce(text, '')) AS t FROM conversations)""",
)
def _(spark, d):
    return views.table(spark, d, "conversations").select(
        "conv_id", "turn", auth.auth_from_authorizer(F.col("text")).alias("auth_method")
    )


@query(
    "k8_url_hosts",
    """SELECT nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host, count(*) AS pages FROM pages GROUP BY host""",
)
def _(spark, d):
    return views.table(spark, d, "pages").groupBy(paths.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query("k9_hash_prefix", "SELECT doc_id, substr(sha256(lang || ':' || coalesce(source, '') || ':' || doc_id), 1, 12) AS id FROM documents")
def _(spark, d):
    return views.table(spark, d, "documents").select(
        "doc_id", paths.endpoint_id(F.col("lang"), F.col("source"), F.col("doc_id").cast("string")).alias("id")
    )


@query(
    "k10_timestamps",
    f"""SELECT event_id, CASE WHEN event_id % 7 = 6 THEN NULL WHEN event_id % 7 IN (2, 3) THEN {ts('ts')} ELSE {ts("date_trunc('second', ts)")} END AS parsed
    FROM events""",
)
def _(spark, d):
    t, i = F.col("ts"), F.col("event_id") % 7
    second, micro = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = (
        F.when(i == 0, F.concat(second, F.lit("+02:00"))).when(i == 1, F.concat(second, F.lit("Z")))
        .when(i == 2, F.concat(micro, F.lit("-0530"))).when(i == 3, F.concat(micro, F.lit("Z")))
        .when(i == 4, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .when(i == 5, F.concat(F.date_format(t, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000")))
        .otherwise(F.concat(F.lit("at "), second))
    )
    parsed = views.events(spark, d).select("event_id", times.any_time(raw).alias("parsed"))
    return parsed.select("event_id", F.date_format("parsed", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query(
    "k11_iso_and_clf_timestamps",
    f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN {ts("date_trunc('second', ts)")} WHEN 1 THEN {ts('ts')} ELSE {ts("date_trunc('day', ts)")} END AS parsed FROM events""",
)
def _(spark, d):
    t, i = F.col("ts"), F.col("event_id") % 3
    clf = F.concat(F.date_format(t, "dd/MMM/yyyy:HH:mm:ss"), F.lit(" -0700"))
    iso = F.when(i == 1, F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).otherwise(F.date_format(t, "yyyy-MM-dd"))
    parsed = F.when(i == 0, times.clf_time(clf)).otherwise(times.loose_iso_time(iso))
    return views.events(spark, d).select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query(
    "k12_time_arithmetic",
    f"""SELECT user_id, {ts("date_trunc('hour', min(ts))")} AS first_hour, {ts('max(ts) - INTERVAL 36 HOUR')} AS earlier,
    round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 + 1e-9, 6) AS seconds FROM events GROUP BY user_id""",
)
def _(spark, d):
    spans = views.events(spark, d).groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return spans.select(
        "user_id", F.date_format(F.date_trunc("hour", "lo"), form).alias("first_hour"),
        F.date_format(F.col("hi") - F.make_dt_interval(hours=F.lit(36)), form).alias("earlier"),
        r6(times.seconds_between(F.col("lo"), F.col("hi")), "seconds"),
    )


@query(
    "k13_math",
    """SELECT l_linenumber, sum(greatest(5, least(50, floor(l_quantity / 10) + 5)))::BIGINT AS clamped, round(sum(abs(l_discount - 0.05)), 4) AS off,
    round(sum(sqrt(l_quantity)), 4) AS roots, sum(floor(l_extendedprice / 100))::BIGINT AS hundreds,
    sum(greatest(5, least(50, floor(l_extendedprice / 10) + 5)))::BIGINT AS sizes, round(sum(CASE WHEN l_quantity > 0 THEN l_tax / l_quantity ELSE 0 END), 4) AS rates
    FROM lineitem GROUP BY l_linenumber""",
)
def _(spark, d):
    q = F.col("l_quantity")
    return views.table(spark, d, "lineitem").groupBy("l_linenumber").agg(
        F.sum(F.greatest(F.lit(5), F.least(F.lit(50), F.floor(q / 10) + 5))).cast("bigint").alias("clamped"),
        F.round(F.sum(F.abs(F.col("l_discount") - 0.05)), 4).alias("off"),
        F.round(F.sum(F.sqrt(q)), 4).alias("roots"),
        F.sum(F.floor(F.col("l_extendedprice") / 100)).cast("bigint").alias("hundreds"),
        F.sum(graph.drawn_size(F.col("l_extendedprice"))).cast("bigint").alias("sizes"),
        F.round(F.sum(inventory.error_rate(F.col("l_tax"), q)), 4).alias("rates"),
    )


@query(
    "k14_json",
    """SELECT event_id, k, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS doc, '{"id":' || event_id || ',"k":' || k || ',"none":null}' AS report FROM ev""",
)
def _(spark, d):
    rows = views.table(spark, d, "events").withColumn("doc", F.from_json("props", "k int"))
    out = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    report = tables.as_json(rows.select(F.col("event_id").alias("id"), F.col("doc.k").alias("k"), F.lit(None).cast("string").alias("none")))
    read = report.select(F.get_json_object("value", "$.id").cast("bigint").alias("event_id"), F.col("value").alias("report"))
    return rows.select("event_id", F.col("doc.k").alias("k"), out.alias("doc")).join(read, "event_id")


@query(
    "k15_arrays",
    """SELECT conv_id, turn, len(list_distinct(words)) AS distinct_words, list_contains(words, 'the') AS has_the,
    array_to_string(list_slice(list_sort(list_distinct(words)), 1, 5), ',') AS first_words,
    '[' || array_to_string(list_transform(list_slice(list_sort(list_distinct(words)), 1, 5), lambda w: chr(39) || w || chr(39)), ', ') || ']' AS quoted
    FROM (SELECT *, string_split(text, ' ') AS words FROM conversations)""",
)
def _(spark, d):
    words = F.array_distinct(F.split("text", " "))
    return views.table(spark, d, "conversations").select(
        "conv_id", "turn", F.size(words).cast("bigint").alias("distinct_words"), F.array_contains(words, "the").alias("has_the"),
        F.array_join(F.slice(F.sort_array(words), 1, 5), ",").alias("first_words"),
        pytext.quoted_list(F.slice(F.sort_array(words), 1, 5)).alias("quoted"),
    )


@query(
    "k16_maps",
    """SELECT user_id, nullif(count(*) FILTER (event_type = 'click'), 0) AS clicks, nullif(count(*) FILTER (event_type = 'error'), 0) AS errors,
    count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""",
)
def _(spark, d):
    # status_distribution makes a map per endpoint: here per user, of event types
    rows = views.events(spark, d).select(F.col("user_id").alias("method"), F.lit("").alias("path_pattern"), F.col("event_type").alias("status_code"))
    maps = anomaly.status_distribution(rows).select(F.col("method").alias("user_id"), F.col("status_codes").alias("m"))
    return maps.select(
        "user_id", F.try_element_at("m", F.lit("click")).alias("clicks"), F.try_element_at("m", F.lit("error")).alias("errors"),
        F.size("m").cast("bigint").alias("kinds"),
    )


@query(
    "k17_conversions",
    """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, TRY_CAST(o_orderstatus AS INTEGER) AS bad,
    TRY_CAST(o_totalprice::VARCHAR AS DOUBLE) AS price, printf('%.0f', o_totalprice) AS whole FROM orders""",
)
def _(spark, d):
    return views.table(spark, d, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).try_cast("int").alias("rank"),
        F.col("o_orderstatus").try_cast("int").alias("bad"), F.col("o_totalprice").cast("string").try_cast("double").alias("price"),
        pytext.whole(F.col("o_totalprice")).alias("whole"),
    )


_OCTET = "CAST(split_part({c}, '.', 4) AS INTEGER)"


@query(
    "k18_subnet_traffic",
    f"""SELECT t.source_ip || '/30' AS target, sum(r.calls)::BIGINT AS calls, sum(r.errors)::BIGINT AS errors, count(*) AS addresses
    FROM (SELECT DISTINCT source_ip FROM rt WHERE source_ip IS NOT NULL) t JOIN (SELECT source_ip, count(*) AS calls,
        count(*) FILTER (status_code >= 400) AS errors FROM rt WHERE source_ip IS NOT NULL GROUP BY source_ip) r
    ON split_part(t.source_ip, '.', 1) = split_part(r.source_ip, '.', 1) AND {_OCTET.format(c='t.source_ip')} // 4 = {_OCTET.format(c='r.source_ip')} // 4
    GROUP BY t.source_ip""",
)
def _(spark, d):
    rows = views.raw_traffic(spark, d)
    targets = rows.filter("source_ip is not null").select(F.concat("source_ip", F.lit("/30")).alias("target")).distinct()
    return network.attribute_subnets(rows, materialize(targets, "targets"))


@query(
    "k18_expand_subnets",
    f"""SELECT source_ip || '/29' AS target, regexp_extract(source_ip, '^(.*\\.)', 1) || ({_OCTET.format(c='source_ip')} // 8 * 8 + n) AS host
    FROM (SELECT DISTINCT source_ip FROM rt WHERE source_ip IS NOT NULL), range(1, 7) r(n)
    UNION ALL SELECT DISTINCT host, host FROM rt WHERE host LIKE 'svc%'""",
)
def _(spark, d):
    rows = views.raw_traffic(spark, d)
    nets = rows.filter("source_ip is not null").select(F.concat("source_ip", F.lit("/29")).alias("target"))
    names = rows.filter("host like 'svc%'").select(F.col("host").alias("target"))
    return network.expand_targets(materialize(nets.union(names).distinct(), "targets"))


_V6 = "SELECT {target} AS target, sum(calls)::BIGINT AS calls, sum(errors)::BIGINT AS errors, count(*) AS addresses FROM r"


@query(
    "k18_ipv6_subnets",
    f"""/*with*/ r AS (SELECT k % 64 AS h, user_id % 65536 AS u, count(*) AS calls, count(*) FILTER (k % 4 = 0) AS errors FROM ev GROUP BY ALL) /*end*/
    {_V6.format(target="'2001:db8::/32'")}
    UNION ALL {_V6.format(target="'2001:0DB8:0:0::/44'")} WHERE h < 16 HAVING count(*) > 0
    UNION ALL {_V6.format(target="'2001:db8:' || lower(to_hex(h)) || '::/48'")} GROUP BY h
    UNION ALL {_V6.format(target="'2001:db8:3::' || lower(to_hex(u))")} WHERE h = 3 GROUP BY u""",
)
def _(spark, d):
    # nets within nets, and addresses as nets of their own
    rows = views.events(spark, d).select(
        F.lower(F.hex(F.col("k") % 64)).alias("h"), F.lower(F.hex(F.col("user_id") % 65536)).alias("u"),
        F.when(F.col("k") % 4 == 0, 500).otherwise(200).alias("status_code"),
    )
    subnet, single = F.concat(F.lit("2001:db8:"), "h", F.lit("::/48")), F.concat(F.lit("2001:db8:3::"), "u")
    targets = rows.select(F.explode(F.array(F.lit("2001:db8::/32"), F.lit("2001:0DB8:0:0::/44"), subnet, single)).alias("target"))
    traffic = rows.withColumn("source_ip", F.concat(F.lit("2001:DB8:"), "h", F.lit("::"), "u"))
    return network.attribute_subnets(traffic, materialize(targets.distinct(), "targets"))
