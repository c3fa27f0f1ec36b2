import math
import re

import pytest
from pyspark.sql import functions as F

from helpers import frame, random_records
from routelens.operators import anomaly


def analyse(records, window, threshold, training=()):
    """Record-by-record detection: what the set-based detectors must agree with."""
    profiles, found = {}, {}

    def keep(kind, source, endpoint, value):
        found.setdefault((kind, source, endpoint), value)

    def view(r):
        pattern = re.sub(r"/\d+", "/{id}", r["path"].rstrip("/")) or "/"
        segments = zip(r["path"].rstrip("/").split("/"), pattern.split("/"))
        rid = next((p for p, q in segments if q.startswith("{") and q.endswith("}")), None)
        source = r["source_ip"] or r["source_service"] or "unknown"
        return f"{r['method']} {pattern}", source, rid

    def learn(p, r, source, rid):
        if r["response_time_ms"] is not None:
            p["ms"].append(r["response_time_ms"])
        p["consumers"].add(source)
        if rid:
            p["ids"].setdefault(source, set()).add(rid)
        p["n"] += 1

    def freeze(p):
        p["mean"] = sum(p["ms"]) / len(p["ms"]) if p["ms"] else 0.0
        p["dev"] = math.sqrt(sum((x - p["mean"]) ** 2 for x in p["ms"]) / len(p["ms"])) if p["ms"] else 0.0
        p["trained"] = True

    new = lambda: {"ms": [], "consumers": set(), "ids": {}, "n": 0, "trained": False}
    for r in training:
        endpoint, source, rid = view(r)
        learn(profiles.setdefault(endpoint, new()), r, source, rid)
    for p in profiles.values():
        if p["n"] >= window:
            freeze(p)

    for r in records:
        endpoint, source, rid = view(r)
        p = profiles.setdefault(endpoint, new())
        if not p["trained"]:
            learn(p, r, source, rid)
            if p["n"] >= window:
                freeze(p)
            continue
        ms = r["response_time_ms"]
        if ms is not None and p["dev"] > 0:
            z = abs(ms - p["mean"]) / p["dev"]
            if z > 3 and ms > p["mean"]:
                keep("data_exfiltration", source, endpoint, (min(z / 10, 1.0), r["timestamp"]))
        if rid:
            p["ids"].setdefault(source, set()).add(rid)
            n = len(p["ids"][source])
            if n > threshold:
                keep("bola", source, endpoint, (min(n / (threshold * 5), 1.0), r["timestamp"]))
        if source not in p["consumers"]:
            keep("new_consumer", source, endpoint, (0.3, r["timestamp"]))
            p["consumers"].add(source)

    by_source = {}
    for r in records:
        by_source.setdefault(view(r)[1], []).append(r)
    for source, rows in by_source.items():
        failed = sum(r["status_code"] in (401, 403) for r in rows)
        if len(rows) >= 10 and failed / len(rows) > 0.8:
            keep("credential_stuffing", source, "multiple", (failed / len(rows), max(r["timestamp"] for r in rows)))
        span = (max(r["timestamp"] for r in rows) - min(r["timestamp"] for r in rows)).total_seconds()
        if len(rows) >= 5 and span > 0 and len(rows) / (span / 60) > 20:
            keep("rate_anomaly", source, "multiple", (min(len(rows) / (span / 60) / 1000, 1.0), max(r["timestamp"] for r in rows)))
        for r in rows:
            endpoint, _, rid = view(r)
            if rid and rid.isdigit():
                ids = sorted(int(x) for x in profiles[endpoint]["ids"].get(source, ()) if x.isdigit())
                if len(ids) >= 10:
                    gaps = [b - a for a, b in zip(ids, ids[1:])]
                    if gaps.count(1) > len(gaps) * 0.7:
                        keep("enumeration", source, endpoint, (gaps.count(1) / len(gaps), None))
    return found


def detected(act):
    rows = anomaly.detect(act, bola_threshold=8, medium_rpm=20, high_rpm=100).collect()
    return {(r.anomaly_type, r.source, r.endpoint): (r.score, r.timestamp) for r in rows}


def same(got, want):
    assert got.keys() == want.keys()
    for key, (value, at) in want.items():
        assert got[key][0] == pytest.approx(value), key
        assert got[key][1] == at, key


@pytest.mark.parametrize("seed, window", [(1, 30), (2, 5), (3, 100), (4, 1), (5, 100000)])
def test_train_then_detect(spark, seed, window):
    records = random_records(seed, 400, hot=0.5)
    act = anomaly.score(anomaly.observations(frame(spark, records, seed)), training_window=window)
    want = analyse(records, window, 8)
    same(detected(act), want)
    kinds = {k[0] for k in want}
    if window == 30:
        assert {"bola", "data_exfiltration", "enumeration", "rate_anomaly"} <= kinds
    if window == 5:
        assert "new_consumer" in kinds


@pytest.mark.parametrize("seed, window", [(6, 40), (7, 10)])
def test_separate_training_set(spark, seed, window):
    records = random_records(seed, 500, hot=0.5)
    training, rest = records[:120], records[120:]
    act = anomaly.score(
        anomaly.observations(frame(spark, rest)), anomaly.observations(frame(spark, training), phase=0), training_window=window
    )
    same(detected(act), analyse(rest, window, 8, training))


def test_credential_stuffing(spark):
    records = random_records(9, 60)
    for r in records:
        r["status_code"] = 401 if r["record_id"] % 10 else 200
    found = anomaly.credential_stuffing(anomaly.activity(anomaly.observations(frame(spark, records)))).collect()
    assert found and all(r.severity == "critical" and r.score > 0.8 for r in found)


def test_enumeration_counts_texts_but_compares_numbers(spark):
    ids = ["1", "01", "2", "3", "4", "5", "6", "7", "8", "9", "10"] + [str(10**25 - 1), str(10**25)]
    rows = random_records(1, len(ids))
    for r, i in zip(rows, ids):
        r.update(method="GET", path=f"/n/{i}", source_ip="1.1.1.1", host=None)
    found = anomaly.enumeration(anomaly.activity(anomaly.observations(frame(spark, rows)))).first()
    # 13 texts and 12 gaps; 1 and 01 are no step, 10 -> 10^25 - 1 neither
    assert (found.details["total_ids"], found.details["sequential_pairs"]) == ("13", "10")
    assert found.details["id_range"] == f"1-{10**25}"


def test_activity_adds_up_over_batches(spark):
    records = random_records(11, 400, hot=0.5)
    rows = frame(spark, records)
    ordered = anomaly.recorded(anomaly.observations(rows))
    profiles = anomaly.train_then_detect(ordered, training_window=30).cache()
    whole = detected(anomaly.activity(ordered, profiles))
    parts = [anomaly.activity(ordered.filter(F.col("record_id") % 3 == i), profiles) for i in range(3)]
    assert detected(anomaly.merge_activity(*parts)) == whole


def test_profile_summary_is_sorted(spark):
    rows = anomaly.profile_summary(anomaly.observations(frame(spark, random_records(2))), training_window=100).collect()
    counts = [r.sample_count for r in rows]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 300
    assert all(sum(r.status_codes.values()) == r.sample_count and r.is_trained == (r.sample_count >= 100) for r in rows)


def test_call_transitions(spark):
    records = random_records(3, 200)
    got = {
        (r.source, r.previous, r.endpoint): r.transitions
        for r in anomaly.call_transitions(anomaly.observations(frame(spark, records))).collect()
    }
    want, last = {}, {}
    for r in records:
        source = r["source_ip"] or r["source_service"] or "unknown"
        endpoint = f"{r['method']} {re.sub(r'/[0-9]+', '/{id}', r['path'].rstrip('/'))}"
        if source in last:
            key = (source, last[source], endpoint)
            want[key] = want.get(key, 0) + 1
        last[source] = endpoint
    assert got == want


def test_identical_records_are_trained_or_scored(spark):
    records = random_records(4, 60)
    for r in records:
        r.update(records[0])  # one line, 60 times
    rows = anomaly.observations(frame(spark, records))
    ordered = anomaly.recorded(rows)
    profiles = anomaly.train_then_detect(ordered, training_window=20).cache()
    row = profiles.first()
    assert row.sample_count == 20 and row.is_trained
    assert ordered.filter(F.col("seq") > row.cut).count() == 0 and row.cut_left
    first = anomaly.activity(ordered, profiles).first()
    assert int(first.first_seq) == int(row.cut) == int(first.first_scored) - 1 and first.requests == 60
    none_left = anomaly.train_then_detect(ordered, training_window=60).first()
    assert none_left.is_trained and not none_left.cut_left


def test_nothing_sorts_all_records(spark):
    rows = anomaly.observations(frame(spark, random_records(4)))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (rows, anomaly.recorded(rows), anomaly.activity(anomaly.recorded(rows)))]
    assert not any("rangepartitioning" in p or "Sort " in p for p in plans)
    profiles = anomaly.train_then_detect(anomaly.recorded(rows), 20)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in profiles


def test_sequence_numbers_follow_time_and_record(spark):
    from datetime import datetime

    times = [None, datetime(1, 1, 1), datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(1970, 1, 1), datetime(2024, 2, 29, 12, 0, 0, 1), datetime(9999, 12, 31)]
    rows = [(t, r, p) for p in (0, 1) for t in times for r in (None, -(2**63), -1, 0, 1, 2**63 - 1)]
    df = spark.createDataFrame([(i, t, r, p) for i, (t, r, p) in enumerate(rows)], "i int, timestamp timestamp_ntz, record_id bigint, phase int")
    numbered = df.select("i", F.when(F.col("phase") == 0, anomaly._sequence(0)).otherwise(anomaly._sequence(1)).alias("seq")).collect()
    assert [r.i for r in sorted(numbered, key=lambda r: r.seq)] == list(range(len(rows)))
    assert len({r.seq for r in numbered}) == len(rows) and all(int(r.seq) % 2 == 0 for r in numbered)


def test_endpoints_without_profile_reach_the_source_detectors(spark):
    records = random_records(9, 100)
    for r in records:
        r.update(method="POST", path="/login", status_code=401, source_ip="9.9.9.9")
    ordered = anomaly.recorded(anomaly.observations(frame(spark, records)))
    none = anomaly.train_then_detect(ordered, 20).filter("method = 'GET'").cache()
    found = {r.anomaly_type for r in anomaly.detect(anomaly.activity(ordered, none)).collect()}
    assert "credential_stuffing" in found and "new_consumer" not in found


def test_raw_rows_are_hashed_and_hot_endpoints_split(spark, monkeypatch):
    from routelens.plans import shared

    ordered = anomaly.recorded(anomaly.observations(frame(spark, random_records(4))))
    profiles = shared.materialize(anomaly.train_then_detect(ordered, 20), "profiles")
    small = anomaly.activity(ordered, profiles)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = anomaly.activity(ordered, profiles)
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortAggregate" not in plan and "_salt" in plan
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange hashpartitioning(method" in above  # the aggregation shuffles again, after combining map-side


@pytest.mark.parametrize("cuts", [(170,), (40, 60, 61, 300)])
def test_batches_in_order_equal_one_detection(spark, tmp_path, cuts):
    """Two and five batches, with the state read from storage each time, one of them run twice."""
    from routelens.plans import behaviour

    records, store = random_records(21, 400, hot=0.5), str(tmp_path)
    records.sort(key=lambda r: (r["timestamp"], r["record_id"]))
    options = {"training_window": 30, "bola_threshold": 8, "medium_rpm": 20, "high_rpm": 100, "buckets": 5, "keep": 2}
    edges = [0, *cuts, len(records)]
    for batch, (a, b) in enumerate(zip(edges, edges[1:])):
        for _ in range(2 if batch == 1 else 1):
            behaviour.fold_behaviour(anomaly.observations(frame(spark, records[a:b])), store, batch, **options)
    got = {(r.anomaly_type, r.source, r.endpoint): (r.score, r.timestamp) for r in behaviour.stored_anomalies(spark, store).collect()}
    same(got, analyse(records, 30, 8))
    with pytest.raises(ValueError, match="cannot run again"):
        behaviour.fold_behaviour(anomaly.observations(frame(spark, records[:5])), store, 0, **options)
