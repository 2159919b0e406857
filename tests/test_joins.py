"""Joins whose lookup side grows with the input never make it a broadcast."""

import pytest
from pyspark.sql import functions as F

from topicloom.operators import relations, schemas, services
from topicloom.operators.skew import salted_join
from topicloom.plans.registered import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def parties(spark):
    return spark.range(3).select(
        F.concat(F.lit("svc-"), "id").alias("service"), F.concat(F.lit("svc-"), "id").alias("root_path"),
        F.lit("java").alias("language"), F.lit("pom.xml").alias("build_file"), F.lit(False).alias("is_stub"),
    )


def test_registry_schemas_are_joined_by_shuffle(spark):
    refs = spark.createDataFrame([("a/R.java", "u", "s", "latest"), ("b/R.java", "u", "s", "1")], "path string, url string, subject string, version string")
    doc = F.concat(F.lit('{"type": "record", "name": "N'), "id", F.lit('", "fields": []}'))
    snapshot = spark.range(1, 3).select(F.lit("s").alias("subject"), F.col("id").alias("version"), doc.alias("schema"))
    found = schemas.registry_schemas(refs, snapshot)
    assert "Broadcast" not in plan(found)
    assert {tuple(r) for r in found.select("path", "schema").collect()} == {("a/R.java", "N2"), ("b/R.java", "N1")}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_repeated_lookup_is_joined_by_shuffle(spark, how):
    rows = spark.range(20).select((F.col("id") % 4).alias("k"), "id")
    lookup = spark.range(2).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = salted_join(rows, lookup, ["k"], how)
    assert "Broadcast" not in plan(joined)
    want = {"inner": 10, "left": 20, "left_semi": 10, "left_anti": 10}
    assert joined.count() == want[how]


def test_services_are_never_broadcast(spark, parties):
    paths = spark.createDataFrame([("svc-1/a.java",), ("svc-9/a.java",)], "path string")
    owned = services.assign_files(paths, parties)
    assert "Broadcast" not in plan(owned)
    assert [r["service"] for r in owned.collect()] == ["svc-1"]
    links = spark.createDataFrame([("svc-0", "svc-1"), ("svc-0", "other")], "source string, target string")
    stubs = relations.stub_services(links, parties)
    assert "Broadcast" not in plan(stubs)
    assert [r["service"] for r in stubs.collect()] == ["other"]


def test_newest_versions_are_never_broadcast(spark, tmp_path):
    rows = [(1, 30), (2, 10), (None, 5)]
    spark.createDataFrame(rows, "p_partkey int, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    found = QUERIES["c6_schema_diff"](spark, str(tmp_path))
    assert "Broadcast" not in plan(found)
    assert sorted((r["schema"], r["field"], r["change"]) for r in found.collect()) == [
        ("Reg1", "color", "added"), ("Reg1", "note", "removed"), ("Reg1", "size", "retyped"), ("Reg2", "color", "added"), ("Reg2", "size", "retyped")
    ]
