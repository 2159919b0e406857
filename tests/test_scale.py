"""Work that is done once, and by all cores, however the tables are stored."""

import pytest
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.operators import extraction, files, skew, topics
from topicloom.operators.numbering import dense_index
from topicloom.plans import corpora
from topicloom.plans.registered import shared
from topicloom.session import materialize


@pytest.mark.parametrize("made", [corpora.build_files, corpora.config_files, corpora.yaml_files])
def test_texts_of_parties_are_rendered_by_all_cores(spark, made):
    customer = spark.range(40).select(
        F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("AUTOMOBILE").alias("c_mktsegment")
    ).coalesce(1)
    texts = made(customer)
    assert texts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert texts.count() == (40 if made is corpora.build_files else 80)


def test_numbering_runs_the_plan_of_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(50).select((F.col("id") * 7 % 50).alias("k")).mapInArrow(count, "k bigint")
    got = sorted(tuple(r) for r in dense_index(rows, ["k"]).select("id", "k").collect())
    assert got == [(i, i) for i in range(50)]
    assert seen.value == 50


def test_a_needle_is_looked_for_once(spark):
    facts = extraction._all_facts(cat.CATALOGUE, False, False)
    for needle in ("@KafkaListener", "@SendTo", "ProducerRecord"):
        assert facts.count(f"contains(content, '{needle}')") == 1


def test_java_suffix_in_any_case_with_a_name(spark):
    paths = ["a.java", "x/B.JaVa", ".java", "x/.java", "a.java\n", "a.javax", "x/ .java", "java", "", None]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r[0] for r in rows.select(files.is_java(F.col("path"))).collect()]
    assert got == [True, True, False, False, False, False, True, False, False, None]


def test_a_join_is_cut_by_the_stored_size(spark, tmp_path, monkeypatch):
    """What a task of the schemas' join sorts does not grow with the tables."""
    lines = spark.range(60).select((F.col("id") % 6).alias("l_suppkey"), (F.col("id") % 20).alias("l_partkey"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(10).select(F.col("id").alias("c_custkey"), F.lit(1).alias("c_nationkey"), F.lit("AUTOMOBILE").alias("c_mktsegment")).write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    monkeypatch.setattr(skew, "TASK_BYTES", 100)
    found = shared.party_schemas(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.service, r.schema) for r in found.collect()} == {(f"svc-{i % 6}", f"Part{i % 20}") for i in range(60)}
    stored = materialize(found, "schemas")
    assert skew.stored_tasks(stored) > 4 and skew.stored_tasks(materialize(spark.range(0), "none")) == 4


@pytest.mark.parametrize("tasks", [None, 7])
def test_schema_usage_in_salted_parts(spark, tasks):
    rows = [("hot", f"svc-{i:03}", "avro", f"n{i}") for i in range(300)] * 2 + [("one", "svc-9", "avro", "x"), ("no", None, "avro", "y")]
    uses = spark.createDataFrame(rows, "schema string, service string, type string, namespace string")
    got = {tuple(r) for r in topics.schema_usage(uses, tasks).collect()}
    assert got == {("hot", "avro", "n0", 300), ("one", "avro", "x", 1), ("no", None, None, 0)}
