"""Registered queries against their oracles on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare
from topicloom.plans.registered import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "x1_match_patterns", "x9_config_topics", "d1_detect_services", "r4_rel_npm", "g1_merge_topics",
    "p1_topic_edges", "p7_nodes_in_cycles", "p11_viz_links", "c2_normalize_field_type", "c3_generated_classes",
    "g2_global_topic_lists", "s1_scan_files", "s3_write_analysis", "i1_incremental_extract",
]


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return db


def test_every_query_has_an_oracle_and_binds(con):
    assert set(ORACLES) == set(QUERIES) <= set(queries())
    for name, sql in oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", SAMPLE)
def test_agrees(spark, con, name):
    said = compare(spark, con, SMALL, name)
    assert said.startswith("ok") and said != "ok 0 rows", said


def test_entry(spark):
    assert entry(spark).columns == ["source", "target", "n_topics"]
