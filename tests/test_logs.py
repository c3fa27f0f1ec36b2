import json

import pytest
from pyspark.sql import functions as F

from helpers import as_of
from routelens.sources import logs, openapi

NGINX = [
    '10.0.1.5 - - [03/Apr/2026:10:15:01 +0000] "GET /api/users/12?full=1 HTTP/1.1" 200 12 "-" "agent" 0.045 "Bearer abc"',
    '10.0.1.6 - bob [03/Apr/2026:10:15:02 +0200] "POST /api/orders HTTP/1.1" 503 1 "-" "agent"',
    '10.0.1.6 - - [03/Apr/2026:10:15:02 +0000] "GET /health HTTP/1.1" 200 1 "-" "agent" 0.1 ""',
    '10.0.1.7 - - [not a time] "PUT /x HTTP/1.1" 401 1 "-" "agent" 1.2.3 "Digest q"',
    "something else",
]
ALB = [
    'https 2026-04-03T10:00:01.5Z app/lb 10.1.1.1:555 10.0.0.1:80 0.001 0.25 0.000 502 - 1 1 "GET https://Shop.Example.com:443/a/7;v=1?x=1 HTTP/1.1" "ua"',
    'http bad app/lb 10.1.1.2:555 - 0.001 -1 -1 200 404 1 1 "PUT /plain?x HTTP/1.1" "ua"',
    "http nope",
]
GATEWAY = [
    {"ip": "1.1.1.1", "requestTime": "03/Apr/2026:10:15:01 +0000", "httpMethod": "GET", "resourcePath": "/u/{id}", "path": "/prod/u/1", "status": "200",
     "responseLatency": "12", "domainName": "gw", "authorizerType": "JWT", "user": "", "caller": "me"},
    {"method": "get", "path": "/x", "status": None, "authorizerType": None},
    {"httpMethod": "", "path": "/x"},
    [1, 2],
]
GENERIC = [
    '  {"@timestamp": "2026-04-03T10:00:01Z", "verb": "put", "uri": "/a/1?x=2", "http_status": 504, "clientIp": "9.9.9.9", "duration": 5, "auth_type": "ApiKey k"}',
    '{"timestamp": "x", "method": "GET", "path": "/b", "response_time": "fast"}',
    '{"method": "GET", "path": "/cut"',
    "app: 2026-04-03T10:00:01Z GET /c?y=1 200 45ms is slow",
    "2026-04-03 10:00:01 DELETE /d 204 0.5s",
    "2026-04-03 10:00:01 FETCH /d 204",
]


def parse(spark, lines, name):
    df = spark.createDataFrame([("f", x if isinstance(x, str) else json.dumps(x)) for x in lines], "file_path string, raw_line string")
    rows = logs.parse_lines(df, name, as_of()).collect()
    return {r.raw_line: r for r in rows}


def short(r):
    return (str(r.timestamp), r.method, r.path, r.status_code, r.source_ip, r.auth_method, r.auth_subject, r.response_time_ms, r.host)


def test_nginx(spark):
    rows = parse(spark, NGINX, "nginx")
    assert len(rows) == 3
    assert short(rows[NGINX[0]]) == ("2026-04-03 10:15:01", "GET", "/api/users/12?full=1", 200, "10.0.1.5", "bearer", None, 45.0, None)
    assert short(rows[NGINX[1]]) == ("2026-04-03 10:15:02", "POST", "/api/orders", 503, "10.0.1.6", "unknown", None, None, None)
    assert short(rows[NGINX[3]]) == ("2024-01-31 00:00:00", "PUT", "/x", 401, "10.0.1.7", "none", None, None, None)


def test_alb(spark):
    rows = parse(spark, ALB, "alb")
    assert len(rows) == 2
    assert short(rows[ALB[0]]) == ("2026-04-03 10:00:01.500000", "GET", "/a/7", 502, "10.1.1.1", "unknown", None, 250.0, "shop.example.com")
    assert short(rows[ALB[1]]) == ("2024-01-31 00:00:00", "PUT", "/plain", 404, "10.1.1.2", "unknown", None, -1000.0, None)


def test_api_gateway(spark):
    rows = parse(spark, GATEWAY, "apigateway")
    assert len(rows) == 2
    assert short(rows[json.dumps(GATEWAY[0])]) == ("2026-04-03 10:15:01", "GET", "/u/{id}", 200, "1.1.1.1", "bearer", "me", 12.0, "gw")
    assert short(rows[json.dumps(GATEWAY[1])]) == ("2024-01-31 00:00:00", "get", "/x", 0, None, "none", None, None, None)


def test_generic(spark):
    rows = parse(spark, GENERIC, "generic")
    assert len(rows) == 4
    assert short(rows[GENERIC[0]]) == ("2026-04-03 10:00:01", "PUT", "/a/1", 504, "9.9.9.9", "api_key", None, 5.0, None)
    assert short(rows[GENERIC[1]]) == ("2024-01-31 00:00:00", "GET", "/b", 0, None, "none", None, None, None)
    # "is slow" holds an s but no ms in the five characters after the match
    assert short(rows[GENERIC[3]]) == ("2026-04-03 10:00:01", "GET", "/c", 200, None, "unknown", None, 45000.0, None)
    assert short(rows[GENERIC[4]]) == ("2026-04-03 10:00:01", "DELETE", "/d", 204, None, "unknown", None, 0.5, None)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("log files")  # a blank in the path on purpose
    (root / "nginx.log").write_bytes(b"\n  \n" + "\n".join(NGINX * 4).encode() + b"\r\n\xff\xfe broken \xff\n")
    (root / "alb.log").write_text("\n".join(ALB * 4))
    (root / "gateway.log").write_text("\n".join(json.dumps(x) for x in GATEWAY * 4))
    (root / "generic.log").write_text("\n".join([GENERIC[3]] * 9))
    # generic JSON with method and path also parses as gateway JSON, which comes first
    (root / "json.log").write_text("\n".join([GENERIC[1]] * 3))
    # 2 of 10 sampled lines parse: under 30 %; the many nginx lines after the sample do not count
    (root / "late.log").write_text("\n".join(["junk"] * 8 + NGINX[:2] * 20))
    (root / "empty.log").write_text("\n \n")
    return root


def test_detection(spark, folder):
    found = logs.detect_formats(logs.head_lines(spark, str(folder))).collect()
    assert {r.file_path.rsplit("/", 1)[-1]: r.log_format for r in found} == {
        "nginx.log": "nginx", "alb.log": "alb", "gateway.log": "apigateway", "generic.log": "generic", "json.log": "apigateway",
        "late.log": "generic",
    }


def test_read_logs_mixes_formats(spark, folder):
    rows = logs.read_logs(spark, str(folder), as_of()).groupBy("discovery_source").count().collect()
    assert {r[0]: r[1] for r in rows} == {"log_nginx": 12, "log_alb": 8, "log_api_gateway": 8 + 3, "log_generic": 9}
    assert logs.scan_lines(spark, str(folder / "nginx.log")).filter(F.col("raw_line").contains("�")).count() == 1


def test_given_path_patterns(spark):
    rows = spark.createDataFrame([("/a/1",), ("/b/2",)], "path string")
    known = spark.createDataFrame([("/a/1", "/a/{x}")], "path string, path_pattern string")
    assert sorted(r.path_pattern for r in logs.with_pattern(rows, known).collect()) == ["/a/{x}", "/b/2"]


SPEC = {
    "openapi": "3.0.3",
    "paths": {
        "/u/{id}": {"get": {"summary": "s"}, "put": {"deprecated": True}, "parameters": [], "trace": {}},
        "/o": {"post": {"deprecated": False}},
    },
}
YAML = """
openapi: 3.0.3
info: {title: t, date: 2024-01-01}
paths:
  /y:
    delete:
      deprecated: true
"""


def test_specs_from_json_and_yaml(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(SPEC, indent=2))
    (tmp_path / "b.yaml").write_text(YAML)
    specs = openapi.read_specs(spark, str(tmp_path), host="h")
    rows = {(r.method, r.path): r.deprecated for r in openapi.spec_operations(specs).collect()}
    assert rows == {("GET", "/u/{id}"): False, ("PUT", "/u/{id}"): True, ("POST", "/o"): False, ("DELETE", "/y"): True}
    assert openapi.deprecated_endpoints(specs).count() == 2
    declared = openapi.declared_endpoints(specs).filter("method = 'PUT'").first()
    assert (declared.host, declared.status, declared.declared_in_spec) == ("h", "deprecated", True)


def test_irregular_specs(spark):
    docs = [
        ('{"paths":{"x-owner":"team","/a":{"get":{}},"/b":{"post":{"deprecated":true}},"/n":null,"/l":[{"get":{}}]}}',),
        ('{"paths":{"/cut":{"get":{}}',), ("[1]",), ('{"paths":[1]}',), ('{"info":{}}',), (None,),
    ]
    specs = spark.createDataFrame([("h", *x) for x in docs], "host string, spec_json string")
    rows = {(r.method, r.path): r.deprecated for r in openapi.spec_operations(specs, skip_unreadable=True).collect()}
    assert rows == {("GET", "/a"): False, ("POST", "/b"): True}
    assert sorted(r.start or "" for r in openapi.unreadable_specs(specs).collect()) == ["", "[1]", '{"paths":{"/cut":{"get":{}}']
    with pytest.raises(Exception, match="spec is no JSON object"):
        openapi.spec_operations(specs).collect()


def test_heads_of_files_without_line_feeds(spark, tmp_path):
    (tmp_path / "one.log").write_bytes(b"x" * (3 * logs.HEAD_BYTES))
    (tmp_path / "mac.log").write_bytes("\r".join(NGINX * 4).encode())
    (tmp_path / "short.log").write_bytes(NGINX[0].encode())
    heads = {}
    for r in logs.head_lines(spark, str(tmp_path)).collect():
        heads.setdefault(r.file_path.rsplit("/", 1)[-1], []).append(r.raw_line)
    assert [len(x) for x in heads["one.log"]] == [logs.HEAD_BYTES]
    assert len(heads["mac.log"]) == min(10, len(NGINX) * 4) and heads["short.log"] == [NGINX[0]]


def test_lines_after_a_blank_head_are_kept(spark, tmp_path):
    lines = "\n".join(NGINX * 4)
    (tmp_path / "lines.log").write_text(" \n" * logs.HEAD_BYTES + lines)
    (tmp_path / "blanks.log").write_text("\t " * logs.HEAD_BYTES + lines)
    (tmp_path / "plain.log").write_text(lines)
    rows = logs.read_logs(spark, str(tmp_path), as_of()).groupBy("file_path", "discovery_source").count().collect()
    assert len(rows) == 3 and len({(r.discovery_source, r["count"]) for r in rows}) == 1


def test_package_is_shipped_once(spark):
    from routelens.session import ship_package

    before = len(spark.sparkContext._jsc.sc().listFiles().mkString(",").split(","))
    ship_package(spark)
    ship_package(spark)
    files = spark.sparkContext._jsc.sc().listFiles().mkString(",").split(",")
    assert len(files) == before and any("routelens" in f for f in files)  # the session has done it already
