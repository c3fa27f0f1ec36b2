"""Third parties and secrets: parts of B, C, D, F, H, K."""

from pyspark.sql import functions as F

from routelens.functions import paths
from routelens.operators import egress
from workload import views
from workload.registry import joined, query, r6, text
from workload.sql import ts


def parts(spark, d):
    return egress.egress_parts(views.traffic(spark, d))


def parties(spark, d):
    return egress.third_parties(parts(spark, d))


def doc_leaks(spark, d):
    return egress.secret_leaks(views.documents_as_egress(spark, d))


def doc_parties(spark, d):
    return egress.third_parties(egress.egress_parts(views.documents_as_egress(spark, d)), doc_leaks(spark, d))


@query(
    "b15_internal_hosts",
    """SELECT host, regexp_matches(lower(host), '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|127\\.|localhost)') AS internal, count(*) AS calls
    FROM rt WHERE host IS NOT NULL GROUP BY host""",
)
def _(spark, d):
    rows = views.raw_traffic(spark, d).filter("host is not null").groupBy("host").agg(F.count("*").alias("calls"))
    return rows.withColumn("internal", paths.is_internal_host(F.col("host")))


_PAGE_HOST = "nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
_HOSTS = f"(SELECT host FROM rt WHERE host IS NOT NULL UNION SELECT {_PAGE_HOST} FROM pages WHERE {_PAGE_HOST} IS NOT NULL)"


def _hosts(spark, d):
    pages = views.table(spark, d, "pages").select(paths.url_host(F.col("url")).alias("host"))
    return views.raw_traffic(spark, d).select("host").union(pages).filter("host is not null").distinct()


@query(
    "c5_identify_provider",
    f"""SELECT host, coalesce(arg_min(provider, priority), 'Unknown') AS provider_name FROM {_HOSTS} h
    LEFT JOIN providers p ON lower(host) = domain OR ends_with(lower(host), '.' || domain) GROUP BY host""",
)
def _(spark, d):
    return egress.identify_providers(_hosts(spark, d))


@query(
    "c6_exclude_internal",
    f"""SELECT host FROM {_HOSTS} h WHERE NOT regexp_matches(lower(host), '^(10\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|192\\.168\\.|127\\.|localhost)')
    AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT regexp_extract({_PAGE_HOST}, '[^.]+\\.[^.]+$') AS domain FROM pages WHERE page_id % 2 = 0)
        WHERE domain <> '' AND (lower(h.host) = domain OR ends_with(lower(h.host), '.' || domain)))""",
)
def _(spark, d):
    even = views.table(spark, d, "pages").filter("page_id % 2 = 0")
    domain = F.regexp_extract(paths.url_host(F.col("url")), r"[^.]+\.[^.]+$", 0)
    own = even.select(domain.alias("domain")).filter("domain <> ''").distinct()
    return egress.drop_internal(_hosts(spark, d), own)


_PARTY = f"""SELECT host, provider_name, total_calls, error_count, round(error_count / total_calls + 1e-9, 6) AS error_rate,
    {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, round(avg_ms + 1e-9, 6) AS avg_latency_ms,
    array_to_string(methods, ',') AS methods, callers AS caller_count, CASE WHEN provider_name = 'Unknown' THEN 'medium' ELSE 'low' END AS risk_level
    FROM parties"""


@query("d15_third_parties", _PARTY)
def _(spark, d):
    return parties(spark, d).select(
        "host", "provider_name", "total_calls", "error_count", r6("error_rate"), text("first_seen"), text("last_seen"),
        r6("avg_latency_ms"), joined("methods"), "caller_count", "risk_level",
    )


@query("d15_third_party_callers", "SELECT host, caller, count(*) AS calls, count(*) FILTER (status_code >= 400) AS errors FROM outbound GROUP BY host, caller")
def _(spark, d):
    return egress.third_party_callers(parts(spark, d))


@query(
    "d16_risk_summary",
    """SELECT count(*) AS total_third_parties, sum(leaks)::BIGINT AS total_secret_leaks, count(*) FILTER (provider_name = 'Unknown') AS unknown_providers,
    count(*) FILTER (errors / calls > 0.1) AS providers_with_errors, count(*) FILTER (risk = 'critical') AS risk_critical,
    count(*) FILTER (risk = 'medium') AS risk_medium, count(*) FILTER (risk = 'low') AS risk_low FROM docrisk""",
)
def _(spark, d):
    return egress.risk_summary(doc_parties(spark, d))


@query("d17_leaks_by_host", "SELECT host, count(*) AS secret_leaks_detected FROM leaks GROUP BY host")
def _(spark, d):
    return egress.leaks_by_host(doc_leaks(spark, d))


@query("d33_leaks_by_type", "SELECT secret_type, host AS destination_host, count(*) AS leaks FROM leaks GROUP BY ALL")
def _(spark, d):
    return egress.leaks_by_type(doc_leaks(spark, d))


@query("f9_third_parties_by_calls", "SELECT host, total_calls FROM parties ORDER BY total_calls DESC, host")
def _(spark, d):
    return egress.third_party_inventory(parties(spark, d)).select("host", "total_calls")


@query(
    "f11_path_samples",
    """SELECT host, string_agg(path, ',' ORDER BY path) AS paths_sample FROM (SELECT host, path, row_number() OVER (PARTITION BY host ORDER BY path) AS f
    FROM (SELECT DISTINCT host, path FROM outbound)) WHERE f <= 10 GROUP BY host""",
)
def _(spark, d):
    outbound = views.traffic(spark, d).filter(F.col("host").isNotNull() & ~paths.is_internal_host(F.col("host")))
    return egress.path_samples(outbound, ["host"], "path", egress.PATH_SAMPLE).select("host", joined("paths_sample"))


@query("h17_egress_risk", "SELECT host, provider_name, leaks AS secret_leaks_detected, risk AS risk_level FROM docrisk")
def _(spark, d):
    return doc_parties(spark, d).select("host", "provider_name", "secret_leaks_detected", "risk_level")


@query("k6_secret_patterns", "SELECT doc_id, secret_type, m AS match FROM secrets")
def _(spark, d):
    from routelens.functions.secrets import find_secrets

    return find_secrets(views.table(spark, d, "documents"), "text", ["doc_id"])


@query(
    "k7_redaction",
    f"""SELECT secret_type, host AS destination_host, caller AS source_service, path, redacted AS matched_pattern, {ts('tm')} AS "timestamp" FROM leaks""",
)
def _(spark, d):
    return doc_leaks(spark, d).select(
        "secret_type", "destination_host", "source_service", "path", "matched_pattern", text("timestamp")
    )
