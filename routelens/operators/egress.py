"""Third-party inventory and secret leaks in outbound traffic."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.functions.paths import egress_source, host_suffixes, is_internal_host, non_empty
from routelens.functions.secrets import find_secrets, redact
from routelens.operators.inventory import error_rate
from routelens.plans.shared import top_k_per_group

# Known providers and their domains; the first provider in this order wins.
PROVIDERS = (
    ("Stripe", ("api.stripe.com",)),
    ("Twilio", ("api.twilio.com",)),
    ("SendGrid", ("api.sendgrid.com",)),
    ("OpenAI", ("api.openai.com",)),
    ("Anthropic", ("api.anthropic.com",)),
    ("AWS S3", ("s3.amazonaws.com", "s3.us-east-1.amazonaws.com")),
    ("AWS SES", ("email.us-east-1.amazonaws.com",)),
    ("Google APIs", ("googleapis.com", "oauth2.googleapis.com")),
    ("GitHub", ("api.github.com",)),
    ("Slack", ("slack.com", "hooks.slack.com")),
    ("Datadog", ("api.datadoghq.com",)),
    ("PagerDuty", ("api.pagerduty.com",)),
    ("Sentry", ("sentry.io",)),
    ("LaunchDarkly", ("app.launchdarkly.com",)),
    ("Auth0", ("auth0.com",)),
    ("Okta", ("okta.com",)),
    ("Firebase", ("firebaseio.com", "fcm.googleapis.com")),
    ("Cloudflare", ("api.cloudflare.com",)),
)
UNKNOWN_PROVIDER = "Unknown"
PATH_SAMPLE = 10
ERROR_SHARE = 0.1


def provider_table(spark: SparkSession) -> DataFrame:
    rows = [(i, name, d) for i, (name, domains) in enumerate(PROVIDERS) for d in domains]
    return spark.createDataFrame(rows, "priority int, provider string, domain string")


def identify_providers(hosts: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """``(host, provider_name)`` for distinct hosts, by exact host or parent domain.

    The suffix match is an equality join: each host offers all its parent domains.  The built-in
    table has a fixed 24 rows and is broadcast; a table of your own is joined without a hint.
    """
    table = F.broadcast(provider_table(hosts.sparkSession)) if providers is None else providers
    offered = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    matched = offered.join(table, "domain", "left").groupBy("host")
    best = F.min_by("provider", F.col("priority"))
    return matched.agg(F.coalesce(best, F.lit(UNKNOWN_PROVIDER)).alias("provider_name"))


def drop_internal(hosts: DataFrame, internal_domains: DataFrame | None = None) -> DataFrame:
    """Distinct hosts that are neither private addresses nor in a table of internal ``domain``s."""
    outside = hosts.filter(~is_internal_host(F.col("host")))
    if internal_domains is None:
        return outside
    domains = internal_domains.select(F.lower("domain").alias("domain"))
    offered = outside.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    inside = offered.join(domains, "domain", "left_semi").select("host")
    return outside.join(inside, "host", "left_anti")


def egress_parts(traffic: DataFrame) -> DataFrame:
    """Outbound calls combined per (host, caller, method): the small table all else rolls up from."""
    outbound = traffic.filter(non_empty(F.col("host")).isNotNull() & ~is_internal_host(F.col("host")))
    caller = egress_source(F.col("source_service"), F.col("source_ip"))
    return outbound.groupBy("host", caller.alias("caller"), "method").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.sum("response_time_ms").alias("ms"),
        F.count("response_time_ms").alias("timed"),
    )


def secret_leaks(traffic: DataFrame) -> DataFrame:
    """Every secret found in the raw line of an outbound record, redacted."""
    outbound = traffic.filter(non_empty(F.col("host")).isNotNull() & ~is_internal_host(F.col("host")))
    keep = [
        F.col("host").alias("destination_host"),
        egress_source(F.col("source_service"), F.col("source_ip")).alias("source_service"),
        "path",
        "timestamp",
    ]
    found = find_secrets(outbound, "raw_line", keep)
    return found.select(
        "secret_type", "destination_host", "source_service", "path", redact(F.col("match")).alias("matched_pattern"),
        "timestamp",
    )


def leaks_by_type(leaks: DataFrame) -> DataFrame:
    return leaks.groupBy("secret_type", "destination_host").agg(F.count("*").alias("leaks"))


def leaks_by_host(leaks: DataFrame) -> DataFrame:
    return leaks.groupBy(F.col("destination_host").alias("host")).agg(F.count("*").alias("secret_leaks_detected"))


def risk_level(provider: Column, leaks: Column) -> Column:
    return (
        F.when(leaks > 0, "critical").when(provider == UNKNOWN_PROVIDER, "medium").otherwise("low")
    )


def third_parties(
    parts: DataFrame,
    leaks: DataFrame | None = None,
    internal_domains: DataFrame | None = None,
    providers: DataFrame | None = None,
) -> DataFrame:
    """One row per external host.  Callers and paths stay in tables of their own, as rows."""
    hosts = parts.groupBy("host").agg(
        F.sum("calls").alias("total_calls"),
        F.sum("errors").alias("error_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        (F.sum("ms") / F.nullif(F.sum("timed"), F.lit(0))).alias("avg_latency_ms"),
        F.sort_array(F.collect_set("method")).alias("methods"),  # a handful of verbs
        F.countDistinct("caller").alias("caller_count"),
    )
    if internal_domains is not None:
        hosts = hosts.join(drop_internal(hosts.select("host"), internal_domains), "host")
    named = hosts.join(identify_providers(hosts.select("host"), providers), "host")
    if leaks is None:
        named = named.withColumn("secret_leaks_detected", F.lit(0).cast("bigint"))
    else:
        named = named.join(leaks_by_host(leaks), "host", "left").withColumn(
            "secret_leaks_detected", F.coalesce("secret_leaks_detected", F.lit(0))
        )
    return named.withColumns(
        {
            "error_rate": error_rate(F.col("error_count"), F.col("total_calls")),
            "risk_level": risk_level(F.col("provider_name"), F.col("secret_leaks_detected")),
        }
    )


def third_party_callers(parts: DataFrame) -> DataFrame:
    return parts.groupBy("host", "caller").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))


def path_samples(traffic: DataFrame, keys: list[str], path: str, k: int) -> DataFrame:
    """The first ``k`` distinct paths per group in text order, as one array of at most ``k``."""
    distinct = traffic.select(*keys, path).distinct()
    few = top_k_per_group(distinct, keys, [F.col(path)], k)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(path)).alias("paths_sample"))


def third_party_inventory(parties: DataFrame) -> DataFrame:
    return parties.orderBy(F.desc("total_calls"), "host")


def risk_summary(parties: DataFrame) -> DataFrame:
    return parties.agg(
        F.count("*").alias("total_third_parties"),
        F.coalesce(F.sum("secret_leaks_detected"), F.lit(0)).alias("total_secret_leaks"),
        F.count_if(F.col("provider_name") == UNKNOWN_PROVIDER).alias("unknown_providers"),
        F.count_if(F.col("error_rate") > ERROR_SHARE).alias("providers_with_errors"),
        *[F.count_if(F.col("risk_level") == r).alias(f"risk_{r}") for r in ("critical", "medium", "low")],
    )
