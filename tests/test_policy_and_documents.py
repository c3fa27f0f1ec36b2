import json
from datetime import timedelta

from pyspark.sql import functions as F

from helpers import START, as_of, frame, random_records
from routelens.operators import accounts, inventory, policy, remediation
from routelens.schemas import ENDPOINTS
from routelens.sources import openapi, tables

LAST = START + timedelta(days=29)


def endpoints(spark, rows):
    defaults = {
        "status": "shadow", "auth_methods_seen": ["bearer"], "discovery_sources": ["log_nginx"], "consumer_count": 1, "total_calls": 5,
        "error_count": 0, "declared_in_spec": False, "first_seen": START, "last_seen": LAST,
    }
    full = [{**defaults, **r, "endpoint_id": r.get("endpoint_id", f"{r['method']}{r['path_pattern']}")} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in ENDPOINTS.fieldNames()) for r in full], ENDPOINTS)


def test_rules(spark):
    rows = endpoints(
        spark,
        [
            {"method": "GET", "path_pattern": "/gone", "status": "active", "total_calls": 7, "consumer_count": 3},
            {"method": "GET", "path_pattern": "/old", "status": "shadow"},
            {"method": "GET", "path_pattern": "/quiet", "status": "zombie", "total_calls": 0},
            {"method": "GET", "path_pattern": "/metrics/x"},
            {"method": "GET", "path_pattern": "/kept", "auth_methods_seen": ["bearer", "none"]},
            {"method": "GET", "path_pattern": "/health/z", "auth_methods_seen": ["none"]},
            {"method": "GET", "path_pattern": "/dep", "total_calls": 101, "endpoint_id": "dep"},
            # the same route on two hosts: the last status in text order counts
            {"method": "PUT", "path_pattern": "/two", "status": "active", "host": "a", "endpoint_id": "z"},
            {"method": "PUT", "path_pattern": "/two", "status": "zombie", "host": "b", "endpoint_id": "a", "total_calls": 2},
        ],
    )
    spec = spark.createDataFrame(
        [("GET", "/kept", False), ("GET", "/health/z", False), ("GET", "/dep", True), ("POST", "/new", False)], "method string, path string, deprecated boolean"
    )
    consumers = spark.createDataFrame(
        [("dep", f"c{i}", START + timedelta(seconds=9 - i)) for i in range(8)], "endpoint_id string, consumer string, first_seen timestamp_ntz"
    )
    found = policy.violations(rows, spec, consumers)
    got = {(r.rule, r.endpoint): (r.severity, r.details) for r in found.collect()}
    assert got == {
        ("BREAKING_CHANGE", "GET /gone"): ("error", "Last seen: 2024-01-30 00:00:00, consumers: 3"),
        ("SHADOW_POLICY_VIOLATION", "GET /gone"): ("error", "Status: active, auth: ['bearer']"),
        ("ENDPOINT_REMOVAL", "GET /old"): ("warning", None),
        ("SHADOW_POLICY_VIOLATION", "GET /old"): ("error", "Status: shadow, auth: ['bearer']"),
        ("ENDPOINT_REMOVAL", "GET /metrics/x"): ("warning", None),
        ("INFRA_ENDPOINT_NOT_IN_SPEC", "GET /metrics/x"): ("info", None),
        ("UNAUTHENTICATED_IN_SPEC", "GET /kept"): ("warning", None),
        ("DEPRECATED_HIGH_TRAFFIC", "GET /dep"): ("warning", "Consumers: ['c7', 'c6', 'c5', 'c4', 'c3']"),
        ("NEW_ENDPOINT", "POST /new"): ("info", None),
        ("ENDPOINT_REMOVAL", "PUT /two"): ("warning", None),
        ("SHADOW_POLICY_VIOLATION", "PUT /two"): ("error", "Status: zombie, auth: ['bearer']"),
    }
    result = policy.validation_result(rows, spec, found).first().asDict()
    assert result == {
        "passed": False, "spec_endpoints": 4, "inventory_endpoints": 9, "new_in_spec": 1, "removed_from_spec": 5, "errors": 4, "warnings": 5,
    }
    relaxed = policy.violations(rows, spec, consumers, fail_on_breaking=False, fail_on_shadow=False)
    assert policy.validation_result(rows, spec, relaxed).first().passed
    lines = {r.line.split("::")[1].split(" ")[0] for r in policy.annotations(found).collect()}
    assert lines == {"error", "warning", "notice"}


def test_openapi_document_is_one_valid_document(spark, tmp_path):
    rows = inventory.classify(inventory.build_endpoints(frame(spark, random_records(3))), as_of())
    lines = remediation.openapi_lines(rows, "2024-01-31")
    tables.write_lines(lines, str(tmp_path / "doc"))
    parts = sorted((tmp_path / "doc").glob("part-*.txt"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert doc["openapi"] == "3.0.3" and [s["url"] for s in doc["servers"]] == ["https://api.stripe.com", "https://x.example.org"]
    assert set(doc["components"]["securitySchemes"]) == {"basicAuth", "bearerAuth"}
    want = {(r.path_pattern, r.method.lower()) for r in rows.collect()}
    assert {(p, m) for p, item in doc["paths"].items() for m in item} == want
    operation = doc["paths"]["/b/{id}/c"]["get"]
    assert operation["operationId"] == "getBByIdC" and operation["tags"] == ["B"]
    assert operation["parameters"][0] == {
        "name": "id", "in": "path", "required": True, "schema": {"type": "string"}, "description": "Auto-detected path parameter: id",
    }
    # the generated document reads back as a spec
    specs = spark.createDataFrame([("h", "u", json.dumps(doc))], "host string, spec_url string, spec_json string")
    assert {(r.path, r.method.lower()) for r in openapi.spec_endpoints(specs).collect()} == want


def test_empty_inventory_still_gives_a_document(spark):
    none = endpoints(spark, [{"method": "GET", "path_pattern": "/x"}]).filter("false")
    text = "".join(r.line for r in remediation.openapi_lines(none, "now").collect())
    assert json.loads(text)["paths"] == {}


def test_operation_parts(spark):
    rows = endpoints(
        spark,
        [
            {"method": "POST", "path_pattern": "/p/{id}", "auth_methods_seen": ["api_key", "none"], "error_count": 3, "avg_response_time_ms": 12.5},
            {"method": "DELETE", "path_pattern": "/", "auth_methods_seen": ["unknown"], "error_count": 2, "status": "deprecated", "first_seen": None, "last_seen": None},
        ],
    )
    ops = {r.method: json.loads(r.operation) for r in remediation.operations(rows).collect()}
    assert set(ops["POST"]["responses"]) == {"201", "500", "401"} and ops["POST"]["security"] == [{"apiKeyAuth": []}]
    assert set(ops["DELETE"]["responses"]) == {"204", "400"} and ops["DELETE"]["security"] == [{}]
    assert ops["DELETE"]["deprecated"] is True and ops["DELETE"]["tags"] == [""] and "parameters" not in ops["DELETE"]
    assert ops["POST"]["description"].splitlines()[2:9] == [
        "- **Status:** shadow", "- **Total calls observed:** 5", "- **Error rate:** 60.0%", "- **Consumers:** 1",
        "- **First seen:** 2024-01-01T00:00:00", "- **Last seen:** 2024-01-30T00:00:00", "- **Avg latency:** 12ms",
    ]
    assert "seen" not in ops["DELETE"]["description"]


def test_firewall_rules(spark):
    rows = endpoints(spark, [{"method": "GET", "path_pattern": "/b/{id}"}, {"method": "GET", "path_pattern": "/a"}])
    block = remediation.nginx_blocks(rows, action="return 403").filter("path_pattern = '/b/{id}'").first().block
    assert block == (
        "# Shadow API: GET /b/{id}\n# Calls: 5, First seen: 2024-01-01 00:00:00\nlocation ~ ^/b/[^/]+$ {\n"
        "    if ($request_method = GET) {\n        return 403;\n    }\n}"
    )
    waf = {r.priority: json.loads(r.rule) for r in remediation.aws_waf_rules(rows).collect()}
    assert waf[101]["VisibilityConfig"]["MetricName"] == "BlockShadowAPI_GET_b__id" and waf[100]["Name"] == "BlockShadowAPI_0"
    assert waf[100]["Statement"]["AndStatement"]["Statements"][0]["ByteMatchStatement"]["FieldToMatch"] == {"Method": {}}
    assert sorted(r.rule_id for r in remediation.modsecurity_rules(rows).collect()) == [900000, 900001]


def test_login_lockout(spark):
    def at(i):
        return START + timedelta(minutes=i)

    rows = [(i, at(i), "login_failure", "ann") for i in range(5)]
    rows += [(10, at(10), "login_failure", "bob"), (11, at(11), "login_success", "bob")]
    rows += [(20 + i, at(20 + i), "login_failure", "cat") for i in range(6)] + [(30, at(30), "login_success", "cat"), (31, at(31), "login_failure", "cat")]
    rows += [(40, at(40), "logout", "dan")]
    audit = spark.createDataFrame(rows, "audit_id long, timestamp timestamp_ntz, action string, username string")
    got = {r.username: (r.last_login_at, r.failed_login_count, r.locked_until) for r in accounts.login_state(audit).collect()}
    assert got == {"ann": (None, 5, at(19)), "bob": (at(11), 0, None), "cat": (at(30), 1, None)}
    assert accounts.audit_log(audit, action="logout").count() == 1
    assert accounts.audit_log(audit, username="ann", limit=2).count() == 2


def test_run_ledger(spark):
    one = spark.range(1)
    run = F.lit(1)

    def event(status, minute, **fields):
        return one.select(*accounts.run_event(run, status, F.lit(START + timedelta(minutes=minute)).cast("timestamp_ntz"), **fields))

    started = event("running", 0, scan_type=F.lit("network"), targets=F.lit("a,b"))
    assert accounts.run_history(started).first().status == "running"
    failed = accounts.run_history(started.unionByName(event("failed", 1, error=F.lit("boom")))).first()
    assert (failed.status, failed.endpoints_found, failed.completed_at) == ("failed: boom", 0, START + timedelta(minutes=1))
    # an event in the same minute as the start still ends the run
    done = accounts.run_history(started.unionByName(event("completed", 0, endpoints_found=F.lit(4)))).first()
    assert (done.status, done.endpoints_found, done.scan_type) == ("completed", 4, "network")
