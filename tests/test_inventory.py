from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from helpers import START, as_of, frame, random_records
from routelens.operators import alerts, inventory, traffic as stats
from routelens.plans import analyze
from routelens.plans.shared import running_sums, top_k_per_group, with_index
from routelens.schemas import ENDPOINTS
from routelens.sources import tables


def fold(records):
    """The record-by-record fold the inventory must agree with."""
    import re

    out = {}
    for r in records:
        pattern = re.sub(r"/\d+", "/{id}", r["path"].rstrip("/")) or "/"
        e = out.setdefault(
            (r["method"], r["host"], pattern),
            {"calls": 0, "errors": 0, "first": None, "last": None, "auth": set(), "consumers": set(), "sources": set(), "ms": [], "running": None},
        )
        e["calls"] += 1
        e["errors"] += r["status_code"] >= 400
        e["first"] = min(e["first"] or r["timestamp"], r["timestamp"])
        e["last"] = max(e["last"] or r["timestamp"], r["timestamp"])
        e["auth"].add(r["auth_method"])
        e["sources"].add(r["discovery_source"])
        consumer = r["auth_subject"] or r["source_ip"] or r["source_service"]
        if consumer:
            e["consumers"].add(consumer)
        ms = r["response_time_ms"]
        if ms is not None:
            e["ms"].append(ms)
            e["running"] = ms if e["running"] is None else (e["running"] * (e["calls"] - 1) + ms) / e["calls"]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_inventory_matches_the_fold_in_any_order(spark, seed):
    records = random_records(seed)
    want = fold(records)
    rows = inventory.build_endpoints(frame(spark, records, shuffle_seed=seed)).collect()
    assert len(rows) == len(want)
    for r in rows:
        e = want[(r.method, r.host, r.path_pattern)]
        assert (r.total_calls, r.error_count, r.first_seen, r.last_seen) == (e["calls"], e["errors"], e["first"], e["last"])
        assert set(r.auth_methods_seen) == e["auth"] and set(r.discovery_sources) == e["sources"]
        assert r.consumer_count == len(e["consumers"])
        assert r.avg_response_time_ms == pytest.approx(sum(e["ms"]) / len(e["ms"])) if e["ms"] else r.avg_response_time_ms is None


@pytest.mark.parametrize("seed", [3, 4])
def test_running_average_matches_the_fold(spark, seed):
    records = random_records(seed, 400, hot=0.6)
    want = {
        spark.range(1).select(inventory.endpoint_id(F.lit(m), F.lit(h), F.lit(p))).first()[0]: e["running"]
        for (m, h, p), e in fold(records).items()
        if e["running"] is not None
    }
    got = {r.endpoint_id: r.running_avg_ms for r in inventory.running_average(frame(spark, records)).collect()}
    assert got == pytest.approx(want)


def test_batches_merge_to_the_whole(spark):
    records = random_records(5)
    parts = [inventory.endpoint_parts(frame(spark, records[i::3])) for i in range(3)]
    whole = inventory.build_endpoints(frame(spark, records)).orderBy("endpoint_id").collect()
    merged = inventory.endpoints_from_parts(inventory.merge_parts(*parts)).orderBy("endpoint_id").collect()
    assert [r.asDict() | {"avg_response_time_ms": 0} for r in merged] == [r.asDict() | {"avg_response_time_ms": 0} for r in whole]


def endpoint(spark, **values):
    defaults = {
        "endpoint_id": "e", "method": "GET", "path_pattern": "/a", "status": "undocumented", "auth_methods_seen": [], "discovery_sources": [],
        "consumer_count": 0, "total_calls": 0, "error_count": 0, "declared_in_spec": False,
    }
    row = {**defaults, **values}
    return spark.createDataFrame([tuple(row.get(n) for n in ENDPOINTS.fieldNames())], ENDPOINTS)


RECENT, OLD = START + timedelta(days=29), START - timedelta(days=9)


@pytest.mark.parametrize(
    "values, status",
    [
        ({"declared_in_spec": True, "total_calls": 3, "last_seen": RECENT}, "active"),
        ({"declared_in_spec": True, "total_calls": 3, "last_seen": OLD}, "zombie"),
        ({"declared_in_spec": True}, "zombie"),
        ({"total_calls": 3, "last_seen": OLD}, "shadow"),
        ({"total_calls": 3, "last_seen": RECENT}, "shadow"),
        ({}, "undocumented"),
        ({"declared_in_spec": True, "last_seen": RECENT}, "undocumented"),
        ({"status": "deprecated", "total_calls": 3, "last_seen": RECENT}, "deprecated"),
    ],
)
def test_classify(spark, values, status):
    assert inventory.classify(endpoint(spark, **values), as_of()).first().status == status


def test_alert_messages(spark):
    row = endpoint(
        spark, status="shadow", total_calls=11, error_count=6, auth_methods_seen=["bearer", "none"], first_seen=START + timedelta(days=29, hours=23, microseconds=5),
    )
    found = {r.alert_type: (r.severity, r.message) for r in alerts.generate_alerts(row, as_of()).collect()}
    assert found == {
        "shadow_api": ("high", "🔴 SHADOW API: GET /a (11 calls, not in any spec)"),
        "unauthenticated": ("high", "⚠️  UNAUTHENTICATED: GET /a receives unauthenticated traffic"),
        "high_error_rate": ("medium", "🟡 HIGH ERROR RATE: GET /a (55% errors over 11 calls)"),
        "new_endpoint": ("info", "🆕 NEW ENDPOINT: GET /a (first seen 2024-01-30T23:00:00.000005)"),
    }
    row = endpoint(spark, status="zombie", total_calls=10, error_count=10)
    assert [r.message for r in alerts.generate_alerts(row, as_of()).collect()] == ["💀 ZOMBIE API: GET /a (in spec but no traffic since None)"]


def test_free_text_alerts_are_typed_by_their_words(spark):
    texts = {"x ZOMBIE API: GET /SHADOW": "shadow_api", "HIGH ERROR RATE": "high_error_rate", "<script>": "other"}
    rows = alerts.type_messages(spark.createDataFrame([(t,) for t in texts], "message string")).collect()
    assert {r.message: r.alert_type for r in rows} == texts


def test_upsert_rules(spark):
    old = endpoint(spark, first_seen=START, last_seen=None, total_calls=9, declared_in_spec=True, service_name="s", status="active")
    new = endpoint(spark, first_seen=None, last_seen=RECENT, total_calls=4, auth_methods_seen=["none"], status="shadow")
    kept = inventory.upsert_endpoints(old, new).first()
    assert (kept.first_seen, kept.last_seen, kept.total_calls, kept.declared_in_spec) == (START, RECENT, 4, True)
    assert (kept.service_name, kept.status, kept.auth_methods_seen) == ("s", "shadow", ["none"])
    erased = inventory.upsert_endpoints(old, new, null_erases=True).first()
    assert (erased.first_seen, erased.last_seen) == (None, RECENT)
    other = endpoint(spark, endpoint_id="f", first_seen=RECENT)
    assert inventory.upsert_endpoints(old, other, null_erases=True).count() == 2


def test_stats_of_no_rows(spark):
    none = frame(spark, random_records(1, 4)).filter("false")
    row = stats.traffic_stats(none).first()
    assert (row.total_requests, row.avg_latency_ms, row.error_count) == (0, 0.0, None)
    assert inventory.report(inventory.build_endpoints(none), as_of()).first().total_endpoints == 0


@pytest.fixture
def many_chunks(spark):
    """Small data would be merged into one chunk; keep the chunks apart to test their seams."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_average_over_many_chunks(spark, many_chunks):
    test_running_average_matches_the_fold(spark, 6)


def test_exact_ranks_with_a_hot_group(spark, many_chunks):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"), F.col("id").alias("pos"),
    ).repartition(6)
    ranked = running_sums(rows, ["key"], ["pos"], {"n": F.lit(1), "odd": F.col("pos") % 2}).toPandas()
    assert ranked["_chunk"].nunique() > 1
    for _, group in ranked.sort_values("pos").groupby("key"):
        assert list(group["n"]) == list(range(1, len(group) + 1))
        assert list(group["odd"]) == list((group["pos"] % 2).cumsum())
    numbered = with_index(rows, ["pos"], "i")
    assert numbered.filter("i <> pos").count() == 0 and numbered.count() == 5000
    top = top_k_per_group(rows, ["key"], [F.desc("pos")], 3).toPandas()
    for key, group in top.groupby("key"):
        assert sorted(group["pos"]) == sorted(rows.filter(F.col("key") == key).toPandas()["pos"])[-3:]


def test_store_is_idempotent_per_batch(spark, tmp_path):
    records = random_records(8, 200)
    spec = spark.createDataFrame([("GET", "/a", None, True)], "method string, path string, host string, deprecated boolean")
    for batch, part, declared in ((0, records[:90], spec), (1, records[90:], None), (1, records[90:], None)):
        report = analyze.fold_batch(spark, frame(spark, part), str(tmp_path), as_of(), batch, declared)
    assert report.endpoints.agg(F.sum("total_calls")).first()[0] == 200
    assert [r.status for r in report.endpoints.filter("host is null and path_pattern = '/a' and method = 'GET'").collect()] == ["deprecated"]
    stored = spark.read.parquet(f"{tmp_path}/alerts")
    assert stored.count() == stored.select("endpoint_id", "alert_type").distinct().count()
    assert sorted(x.name for x in (tmp_path / "endpoints" / "manifests").iterdir() if x.name.isdigit()) == ["0", "1"]


COUNTS = ["endpoint_id", "total_calls", "error_count", "consumer_count", "status", "first_seen", "last_seen", "declared_in_spec"]


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_older_batch_again_renews_the_newest_snapshot(spark, tmp_path):
    records = random_records(8, 60)
    for batch, part in ((0, records[:30]), (1, records[30:]), (0, records[:10])):
        report = analyze.fold_batch(spark, frame(spark, part), str(tmp_path / "a"), as_of(), batch, keep=2)
    fresh = analyze.fold_batch(spark, frame(spark, records[:10]), str(tmp_path / "b"), as_of(), 0)
    fresh = analyze.fold_batch(spark, frame(spark, records[30:]), str(tmp_path / "b"), as_of(), 1)
    assert rows_of(report.endpoints, COUNTS) == rows_of(fresh.endpoints, COUNTS)
    assert report.summary.first() == fresh.summary.first()
    alerts_of = lambda x: rows_of(spark.read.parquet(str(tmp_path / x / "alerts")), ["batch_id", "endpoint_id", "alert_type"])
    assert alerts_of("a") == alerts_of("b")
    for batch in (2, 3):
        analyze.fold_batch(spark, frame(spark, records[:5]), str(tmp_path / "a"), as_of(), batch, keep=2)
    with pytest.raises(ValueError, match="part of the snapshot of batch 2"):
        analyze.fold_batch(spark, frame(spark, records[:5]), str(tmp_path / "a"), as_of(), 1, keep=2)


def test_batches_in_steps_equal_one_inventory(spark, tmp_path):
    """Specs that change, time that passes without traffic, and endpoints that batches do not touch."""
    records = random_records(14, 240)
    spec = lambda *rows: spark.createDataFrame(rows, "method string, path string, host string, deprecated boolean")
    first = spec(("GET", "/a", None, False), ("GET", "/items/{id}", "api.stripe.com", False), ("PUT", "/never", "", False))
    second = spec(("GET", "/a", None, True), ("POST", "/a", None, False), ("GET", "/items/{id}", "api.stripe.com", False))
    store, seen = str(tmp_path), []
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    steps = [(records[:80], first, "2024-01-02 00:00:00"), (records[80:81], second, "2024-01-03 00:00:00"), (records[81:], None, "2024-01-03 00:00:00"), ([], None, "2024-03-01 00:00:00")]
    for batch, (part, declared, now) in enumerate(steps):
        seen += part
        report = analyze.fold_batch(spark, frame(spark, part), store, at(now), batch, declared, buckets=7)
        known = first if batch == 0 else first.unionByName(second)
        want = analyze.inventory_report(inventory.endpoint_parts(frame(spark, seen)), at(now), known)
        assert rows_of(report.endpoints, COUNTS) == rows_of(want.endpoints, COUNTS)
        assert report.summary.first() == want.summary.first()
        stored = spark.read.parquet(f"{store}/alerts").select("endpoint_id", "alert_type")
        raised = {tuple(r) for r in want.alerts.select("endpoint_id", "alert_type").collect()}
        assert raised <= {tuple(r) for r in stored.collect()} and stored.count() == stored.distinct().count()


def test_files_of_a_batch_stay_flat_over_many_batches(spark, tmp_path):
    """Batches of one endpoint each, over a store of many, write and keep as much at the end as at the beginning."""
    records, store = random_records(9, 400, hot=0.0), str(tmp_path)
    analyze.fold_batch(spark, frame(spark, records), store, as_of(), 0, buckets=16, keep=3)
    one = [records[0] | {"record_id": 10_000}]
    written, kept = [], []
    for batch in range(1, 13):
        before = {p for p in tmp_path.rglob("*") if p.is_file()}
        report = analyze.fold_batch(spark, frame(spark, one), store, as_of(), batch, buckets=16, keep=3)
        files = {p for p in tmp_path.rglob("*") if p.is_file()}
        written.append(len([p for p in files - before if p.suffix == ".parquet"]))
        kept.append(len([p for p in files if p.suffix == ".parquet" and {"parts", "endpoints", "deltas"} & set(p.parts)]))
    assert max(written) <= min(written) + 1 and max(written) <= 6
    assert kept[4:] == [kept[4]] * len(kept[4:])
    assert report.endpoints.agg(F.sum("total_calls")).first()[0] == 412


def test_analyze_logs_end_to_end(spark, tmp_path):
    line = '10.0.0.{i} - - [30/Jan/2024:10:00:0{i} +0000] "GET /users/{i} HTTP/1.1" {s} 1 "-" "ua" 0.5 ""'
    (tmp_path / "a.log").write_text("\n".join(line.format(i=i, s=500 if i < 4 else 200) for i in range(9)))
    report = analyze.analyze_logs(spark, str(tmp_path / "a.log"), str(tmp_path / "store"), as_of(), batch_id=0)
    row = report.endpoints.first()
    assert (row.method, row.path_pattern, row.total_calls, row.error_count, row.status) == ("GET", "/users/{id}", 9, 4, "shadow")
    assert row.consumer_count == 9 and row.avg_response_time_ms == 500.0
    assert report.summary.first().shadow_endpoints == 1
    again = analyze.analyze_logs(spark, str(tmp_path / "a.log"), str(tmp_path / "store"), as_of(), batch_id=0)
    assert again.endpoints.first().total_calls == 9


def test_state_is_compacted_and_replayed(spark, tmp_path):
    records = random_records(12, 120)
    root = str(tmp_path / "parts")
    want = inventory.build_endpoints(frame(spark, records)).select("endpoint_id", "total_calls", "consumer_count")
    for batch in (0, 1, 2, 3, 3):
        part = inventory.endpoint_parts(frame(spark, records[batch::4]))
        state = tables.fold_state(root, part, batch, inventory.merge_parts, compact_every=2)
    got = inventory.endpoints_from_parts(state).select("endpoint_id", "total_calls", "consumer_count")
    assert sorted(got.collect()) == sorted(want.collect())
    assert tables.latest_version(spark, root) == 3 and tables.latest_version(spark, root, before=3) == 1
    # batch 2 again: later batches do not leak into it
    again = tables.fold_state(root, inventory.endpoint_parts(frame(spark, records[2::4])), 2, inventory.merge_parts, compact_every=2)
    assert again.agg(F.sum("calls")).first()[0] == 90


def test_broadcast_is_decided_by_measured_size(spark, monkeypatch):
    from routelens.plans import shared

    table = shared.materialize(spark.range(1000).withColumnRenamed("id", "k"), "small")
    other = spark.range(50).withColumnRenamed("id", "k")

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "strategy=broadcast" in plan(other.join(shared.broadcast_if_small(table), "k"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 999)
    assert "strategy=broadcast" not in plan(other.join(shared.broadcast_if_small(table), "k"))


def test_a_cluster_needs_a_shared_folder():
    from routelens.plans import shared

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared.shared_folder(Session())


def test_days_are_compacted_and_read_alone(spark, tmp_path):
    from routelens.plans import layout

    records, store = random_records(15, 300), str(tmp_path)
    for i, r in enumerate(records):
        r["timestamp"] = None if i % 50 == 49 else r["timestamp"].replace(day=1 + i % 3)
    traffic = frame(spark, records).select(*layout._ROW.fieldNames())
    count = lambda df: df.groupBy(F.col("timestamp").cast("date").cast("string").alias("d")).count().collect()
    want = {r.d: r["count"] for r in count(traffic)}
    for batch in range(9):
        analyze.store_traffic(traffic.filter(F.col("record_id") % 9 == batch), store, batch)
        if batch in (2, 4, 6):
            layout.compact_traffic(spark, store, batch, keep=1)
            layout.compact_traffic(spark, store, batch, keep=1)  # nothing is left to do
    assert {r.d: r["count"] for r in count(layout.read_traffic(spark, store))} == want
    assert sorted(x.name for x in (tmp_path / "traffic").iterdir()) == [f"batch_id={b}" for b in (5, 6, 7, 8)]
    some = layout.read_traffic(spark, store, "2024-01-02", "2024-01-02")
    assert {r.d: r["count"] for r in count(some)} == {"2024-01-02": want["2024-01-02"]}
    assert some.inputFiles() and all("dt=2024-01-02/" in x for x in some.inputFiles())
    days = {p.parent for p in (tmp_path / "traffic-days").rglob("*.parquet")}
    assert len(days) == 4 and all(len(list(d.glob("*.parquet"))) == 1 for d in days)


def test_a_compaction_sorts_a_bounded_number_of_rows_per_task(spark, tmp_path, monkeypatch):
    from routelens.plans import layout

    monkeypatch.setattr(layout, "SORT_BYTES", 100_000, raising=False)
    at, store = START, str(tmp_path)
    records = [
        {**r, "record_id": i, "timestamp": [None, at, at, at + timedelta(seconds=i)][i % 4], "path": "/a" * 100}
        for i, r in enumerate(random_records(16, 300) * 8)
    ]
    traffic = frame(spark, records).select(*layout._ROW.fieldNames())
    for batch in range(2):
        analyze.store_traffic(traffic.filter(F.col("record_id") % 2 == batch), store, batch)
        layout.compact_traffic(spark, store, batch)
    got = layout.read_traffic(spark, store)
    assert sorted(r.record_id for r in got.select("record_id").collect()) == list(range(2400))
    files = got.groupBy(F.input_file_name(), F.col("timestamp").isNull().alias("untimed")).count().collect()
    assert sum(r.untimed for r in files) > 2 and sum(not r.untimed for r in files) > 2
    assert max(r["count"] for r in files) < 500  # some 600 bytes each in a sort
