"""Registered queries against their SQL, on the smallest data set.

``tools/compare.py`` does the same for all queries at any size; set ROUTELENS_ALL=1 to do it here.
"""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import TABLES, canonical
from workload import EXPECTED, QUERIES

FOLDER = "/root/testdata/sf0.001"
SOME = """a2_nginx_format a7_json_text_dispatch a8_format_detection a10_spec_files a14_append_traffic a15_upsert_endpoints b1_normalize_path
b7_url_parts c1_merge_state_and_batch c6_exclude_internal c9_valid_sessions c10_correlate_spec d2_running_average d6_inventory_report d7_traffic_stats
d12_inventory_gauges d14_latency_histogram d16_risk_summary d21_profile_summary d30_validation_counters e4_train_then_detect e7_call_transitions
a10_irregular_specs c12_orphans h16_passed_by_option i1_inventory_graph j1_nginx_document j4_openapi_document k16_maps l2_tail_detects_formats l5_alerts_per_cycle
f8_all_anomalies h14_deprecated_high_traffic h18_ci_annotations i2_combined_graph i4_single_points_of_failure i9_graph_export j2_waf_rules
j7_descriptions k7_redaction k18_expand_subnets l6_spec_correlation l7_streaming_anomalies l9_windowed_timeline""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries()) if os.environ.get("ROUTELENS_ALL") else SOME)
def test_query_matches_its_sql(spark, db, name):
    df = queries()[name](spark, FOLDER)
    found = db.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["endpoint_id", "status"] and df.count() > 0


def test_every_query_has_sql():
    assert QUERIES.keys() == EXPECTED.keys()
    assert oracle_sql().keys() <= queries().keys()
