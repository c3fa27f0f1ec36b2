"""Path, URL and host expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path-parameter rules, applied in this order.  Digits are Unicode decimal digits.
PATH_RULES = (
    (r"/\p{Nd}+", "/{id}"),
    (r"(?i)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "/{uuid}"),
    (r"(?i)/[0-9a-f]{24}", "/{objectId}"),
    (r"/[A-Za-z0-9_-]{20,}", "/{token}"),
)
# URL prefixes of infrastructure routes.
INFRA_PREFIXES = ("/health", "/ready", "/metrics", "/internal/", "/.well-known/")
UNAUTH_EXEMPT_PREFIXES = ("/health", "/ready", "/metrics")
# Hosts that never count as third parties.
INTERNAL_HOST = r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|127\.|localhost)"


def non_empty(c: Column) -> Column:
    """NULL for the empty string, so ``coalesce`` skips it."""
    return F.nullif(c, F.lit(""))


def normalize_path(path: Column, anchored: bool = False) -> Column:
    """Concrete path -> pattern: ``/users/42/orders/`` becomes ``/users/{id}/orders``.

    Rules are prefix rules: ``/42abc`` becomes ``/{id}abc``, and a uuid that starts with a digit
    is caught by the digit rule first.  ``anchored=True`` only rewrites whole segments.
    """
    def apply(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
        for pattern, replacement in rules:
            if anchored:
                pattern += r"(?=/|$)"
            text = F.regexp_replace(text, pattern, replacement.replace("{", r"\{"))
        return text

    digits = apply(F.rtrim(path, F.lit("/")), PATH_RULES[:1])
    # the other rules need a slash and at least 20 more characters
    out = F.when(F.length(digits) > 20, apply(digits, PATH_RULES[1:])).otherwise(digits)
    return F.when(out == "", F.lit("/")).otherwise(out)


def endpoint_id(method: Column, host: Column, pattern: Column) -> Column:
    """First 12 hex digits of sha256 over ``method:host:pattern``; never NULL.

    Saying so (``coalesce``) matters: for a join on a nullable computed key Spark adds a NULL test
    and moves it, hash and all, down to the rows before an aggregation.
    """
    key = F.concat_ws(":", method, F.coalesce(host, F.lit("")), pattern)
    return F.coalesce(F.substring(F.sha2(key, 256), 1, 12), F.lit(""))


def endpoint_name(method: Column, pattern: Column) -> Column:
    return F.concat_ws(" ", method, pattern)


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def url_path(url: Column) -> Column:
    """Path of an absolute URL without scheme, host, query, fragment and trailing ``;params``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path.contains(";"), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)


def url_host(url: Column) -> Column:
    """Lower-cased host name of an absolute URL, without user info, port and IPv6 brackets."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:\[/?#]*)", 1)
    return non_empty(F.lower(F.translate(host, "[]", "")))


def inventory_consumer(auth_subject: Column, source_ip: Column, source_service: Column) -> Column:
    """Who called, for the inventory: subject, else address, else service; NULL when unknown."""
    return F.coalesce(non_empty(auth_subject), non_empty(source_ip), non_empty(source_service))


def anomaly_source(source_ip: Column, source_service: Column) -> Column:
    return F.coalesce(non_empty(source_ip), non_empty(source_service), F.lit("unknown"))


def egress_source(source_service: Column, source_ip: Column) -> Column:
    return F.coalesce(non_empty(source_service), non_empty(source_ip), F.lit("unknown"))


def is_internal_host(host: Column) -> Column:
    """Private and loopback prefixes, and anything starting with ``localhost``."""
    return F.lower(host).rlike(INTERNAL_HOST)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``: the array a suffix match joins on by equality."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def consumer_node_name(consumer: Column) -> Column:
    return F.when(
        consumer.startswith("10.") | consumer.startswith("172.") | consumer.startswith("192.168."),
        F.concat(F.lit("internal-"), consumer),
    ).otherwise(consumer)


def starts_with_any(path: Column, prefixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | path.startswith(prefix)
    return hit


def is_infra_path(path: Column) -> Column:
    return starts_with_any(path, INFRA_PREFIXES)


def resource_id(path: Column, pattern: Column) -> Column:
    """First path segment that lines up with a ``{...}`` segment of the pattern; NULL if none."""
    # up to and including the brace: its number of segments is the position of the id
    before = F.regexp_extract(pattern, r"^((?:[^/]*/)*?\{)[^/]*\}(?:/|$)", 1)
    position = F.array_size(F.split(non_empty(before), "/"))
    return non_empty(F.split_part(path, F.lit("/"), position))
