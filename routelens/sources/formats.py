"""Access-log formats as column expressions.

A format is two steps.  ``split`` runs the expensive operations (one regular expression or one
JSON parse each) as named columns, and ``record`` picks typed fields from them.  Keeping the steps
in separate projections makes Spark evaluate the expensive part once per line, not once per field.

A line that does not parse gives a NULL record.  A timestamp that does not parse becomes the
``ingest_time`` the caller passes in.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelens.functions.auth import auth_from_authorizer, auth_from_header
from routelens.functions.paths import non_empty, strip_query, url_host, url_path
from routelens.functions.times import any_time, clf_time, loose_iso_time

# Line layouts.
NGINX_LINE = (
    r"(\S+)\s+-\s+\S+\s+\[([^\]]+)\]\s+"
    r'"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+\d+\s+"[^"]*"\s+"[^"]*"'
    r'(?:\s+([\d.]+))?(?:\s+"([^"]*)")?'
)
ALB_LINE = (
    r"\S+\s+(\S+)\s+\S+\s+(\S+)\s+\S+\s+\S+\s+(\S+)\s+\S+\s+(\d{3})\s+(\d{3}|-)\s+\S+\s+\S+\s+"
    r'"(\S+)\s+(\S+)\s+\S+"\s+"[^"]*"'
)
TEXT_LINE = (
    r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\S*)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+"
    r"(/\S+)\s+(\d{3})(?:\s+([\d.]+)\s*(?:ms|s)?)?"
)
# Paths the nginx format drops as noise.
NGINX_NOISE = ("/favicon.ico", "/robots.txt", "/health", "/healthz")
# JSON keys per field, first one present wins.
METHOD_KEYS = ("method", "httpMethod", "http_method", "request_method", "verb")
PATH_KEYS = ("path", "url", "uri", "request_uri", "resourcePath", "request_path")
STATUS_KEYS = ("status", "status_code", "statusCode", "response_code", "http_status")
TIME_KEYS = ("timestamp", "time", "@timestamp", "date", "requestTime")
LATENCY_KEYS = ("response_time", "responseTime", "latency", "duration", "responseLatency")
IP_KEYS = ("ip", "client_ip", "remote_addr", "source_ip", "clientIp")
HOST_KEYS = ("host", "hostname", "domainName", "server_name")
AUTH_KEYS = ("authorization", "auth", "auth_type")
GATEWAY_KEYS = (
    "httpMethod", "method", "resourcePath", "path", "requestTime", "status", "authorizerType",
    "responseLatency", "ip", "user", "caller", "domainName",
)

_JSON_OPTIONS = {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt_record"}


@dataclass(frozen=True)
class LogFormat:
    name: str
    split: Callable[[Column], dict[str, Column]]
    record: Callable[[dict[str, Column], Column], Column]

    def columns(self, line: Column, condition: Column | None = None) -> dict[str, Column]:
        """Helper columns for lines of this format; NULL where ``condition`` does not hold."""
        parts = self.split(line)
        return {
            f"_{self.name}_{k}": c if condition is None else F.when(condition, c) for k, c in parts.items()
        }

    def parse(self, line: Column, ingest_time: Column) -> Column:
        """The record struct, from the helper columns of ``columns``."""
        return self.record({k: F.col(f"_{self.name}_{k}") for k in self.split(line)}, ingest_time)


def _groups(line: Column, pattern: str, count: int, anchored: bool = True) -> Column:
    """All capture groups of one match as an array, by one regex run per line.

    The match is rewritten to its groups joined by line feeds, which a text line never contains.
    Without a match the array has one element: see ``_matched``.
    """
    head = "^" if anchored else r"^[\s\S]*?"
    joined = F.regexp_replace(line, head + pattern + r"[\s\S]*$", "\n".join(f"${i + 1}" for i in range(count)))
    return F.split(joined, "\n")


def _matched(groups: Column, count: int) -> tuple[Column, list[Column]]:
    """Whether the line matched, and its groups."""
    return F.size(groups) == count, [F.get(groups, F.lit(i)) for i in range(count)]


def _json(line: Column, keys: tuple[str, ...]) -> Column:
    names = ", ".join(f"`{k}` string" for k in (*keys, "_corrupt_record"))
    return F.from_json(line, names, _JSON_OPTIONS)


def _record(present: Column, **fields: Column) -> Column:
    """The traffic fields as one struct; fields a format does not carry are NULL."""
    types = {
        "timestamp": "timestamp_ntz", "method": "string", "path": "string", "status_code": "int",
        "source_ip": "string", "source_service": "string", "auth_method": "string",
        "auth_subject": "string", "response_time_ms": "double", "host": "string",
        "discovery_source": "string",
    }
    cols = [fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()]
    return F.when(present, F.struct(*cols))


def _nginx_record(groups: Column, ingest_time: Column) -> Column:
    matched, f = _matched(groups, 7)
    header = non_empty(f[6])
    return _record(
        matched & ~f[3].isin(*NGINX_NOISE),
        timestamp=F.coalesce(clf_time(f[1]), ingest_time),
        method=f[2],
        path=f[3],
        status_code=f[4],
        source_ip=f[0],
        auth_method=F.when(header.isNotNull(), auth_from_header(header)).otherwise("unknown"),
        response_time_ms=f[5].try_cast("double") * 1000,
        discovery_source=F.lit("log_nginx"),
    )


def _alb_record(groups: Column, ingest_time: Column) -> Column:
    matched, f = _matched(groups, 7)
    url = f[6]
    bare = strip_query(url)
    absolute = bare.startswith("http") & bare.contains("://")
    return _record(
        matched,
        timestamp=F.coalesce(loose_iso_time(f[0]), ingest_time),
        method=f[5],
        path=F.when(absolute, url_path(bare)).otherwise(bare),
        status_code=F.when(f[4] != "-", f[4]).otherwise(f[3]),
        source_ip=F.regexp_replace(f[1], ":[^:]*$", ""),
        auth_method=F.lit("unknown"),
        response_time_ms=f[2].try_cast("double") * 1000,  # -1 (no target) stays -1000
        host=F.when(url.startswith("http"), url_host(url)),
        discovery_source=F.lit("log_alb"),
    )


def _gateway_record(j: Column, ingest_time: Column) -> Column:
    method = F.coalesce(non_empty(j["httpMethod"]), non_empty(j["method"]))
    path = F.coalesce(non_empty(j["resourcePath"]), non_empty(j["path"]))
    return _record(
        j["_corrupt_record"].isNull() & method.isNotNull() & path.isNotNull(),
        timestamp=F.coalesce(clf_time(j["requestTime"]), ingest_time),
        method=method,
        path=path,
        status_code=F.coalesce(j["status"].try_cast("int"), F.lit(0)),
        source_ip=j["ip"],
        auth_method=auth_from_authorizer(j["authorizerType"]),
        auth_subject=F.coalesce(non_empty(j["user"]), j["caller"]),
        response_time_ms=j["responseLatency"].try_cast("double"),
        host=j["domainName"],
        discovery_source=F.lit("log_api_gateway"),
    )


def _generic_record(doc: Column, groups: Column, ingest_time: Column) -> Column:
    """JSON and text lines end in the same raw fields, which are converted once for both."""
    is_doc = doc.isNotNull()
    matched, f = _matched(groups, 6)

    def raw(keys: tuple[str, ...], group: Column | None) -> Column:
        first = F.coalesce(*[doc[k] for k in keys])
        return F.when(is_doc, first) if group is None else F.when(is_doc, first).otherwise(group)

    method, path = non_empty(raw(METHOD_KEYS, f[1])), non_empty(raw(PATH_KEYS, f[2]))
    readable = F.when(is_doc, doc["_corrupt_record"].isNull() & method.isNotNull() & path.isNotNull()).otherwise(matched)
    header = F.coalesce(*[doc[k] for k in AUTH_KEYS], F.lit(""))
    latency = raw(LATENCY_KEYS, f[4]).try_cast("double")
    # a text unit is looked for in the five characters after the match, not in the match itself
    seconds = ~is_doc & f[5].contains("s") & ~f[5].contains("ms")
    return _record(
        readable,
        timestamp=F.coalesce(any_time(raw(TIME_KEYS, f[0])), ingest_time),
        method=F.upper(method),
        path=strip_query(path),
        status_code=F.coalesce(raw(STATUS_KEYS, f[3]).try_cast("int"), F.lit(0)),
        source_ip=raw(IP_KEYS, None),
        auth_method=F.when(is_doc, auth_from_header(header)).otherwise("unknown"),
        response_time_ms=F.when(seconds, latency * 1000).otherwise(latency),
        host=raw(HOST_KEYS, None),
        discovery_source=F.lit("log_generic"),
    )


def _is_json(line: Column) -> Column:
    return F.ltrim(line).startswith("{")


GENERIC_KEYS = tuple(
    dict.fromkeys(
        METHOD_KEYS + PATH_KEYS + STATUS_KEYS + TIME_KEYS + LATENCY_KEYS + IP_KEYS + HOST_KEYS + AUTH_KEYS
    )
)

NGINX = LogFormat(
    "nginx",
    lambda line: {"f": _groups(line, NGINX_LINE, 7)},
    lambda parts, ingest_time: _nginx_record(parts["f"], ingest_time),
)
ALB = LogFormat(
    "alb",
    lambda line: {"f": _groups(line, ALB_LINE, 7)},
    lambda parts, ingest_time: _alb_record(parts["f"], ingest_time),
)
APIGATEWAY = LogFormat(
    "apigateway",
    lambda line: {"j": _json(line, GATEWAY_KEYS)},
    lambda parts, ingest_time: _gateway_record(parts["j"], ingest_time),
)
GENERIC = LogFormat(
    "generic",
    lambda line: {
        "doc": F.when(_is_json(line), _json(line, GENERIC_KEYS)),
        "text": F.when(~_is_json(line), _groups(line, TEXT_LINE + r"([\s\S]{0,5})", 6, anchored=False)),
    },
    lambda parts, ingest_time: _generic_record(parts["doc"], parts["text"], ingest_time),
)

# Register a format of your own by adding a LogFormat here.  The order of the first three breaks
# ties in auto-detection; "generic" is the fallback.
FORMATS: dict[str, LogFormat] = {f.name: f for f in (NGINX, ALB, APIGATEWAY, GENERIC)}
SPECIFIC = ("nginx", "alb", "apigateway")
