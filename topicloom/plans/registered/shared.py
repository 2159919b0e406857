"""Tables several registered queries start from.

Lazy plans, but for the ``stored_`` ones: a query that uses the facts more than once
writes them to the shared folder first, so that no text is read twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.operators import extraction, graph, schemas, services, topics
from topicloom.operators.skew import stored_tasks
from topicloom.plans import corpora
from topicloom.plans.corpora import table
from topicloom.session import materialize


def found_services(spark: SparkSession, sf: str) -> DataFrame:
    return services.upsert_services(
        services.detect_services(corpora.build_files(table(spark, sf, "customer")))
    )


def roles(spark: SparkSession, sf: str) -> DataFrame:
    facts = extraction.role_facts(corpora.trade_files(spark, sf))
    return topics.topic_roles(facts, found_services(spark, sf))


def members(spark: SparkSession, sf: str) -> DataFrame:
    facts = extraction.role_facts(corpora.trade_files(spark, sf), locate=False)
    return topics.topic_members(services.assign_files(facts, found_services(spark, sf)))


def stored_roles(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(roles(spark, sf), "roles")


def stored_members(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(members(spark, sf), "members")


def topic_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.topic_edges(stored_members(spark, sf))


def service_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Who feeds whom, over all topics."""
    return materialize(topic_edges(spark, sf).select("source", "target").distinct(), "edges")


def stored_schemas(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(party_schemas(spark, sf), "schemas")


def party_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of keys are written first: their size says into how many tasks the join is cut."""
    pairs = materialize(corpora.party_pairs(table(spark, sf, "lineitem")), "pairs")
    records = schemas.avro_schemas(corpora.party_avsc(pairs))
    return schemas.owned_schemas(records, found_services(spark, sf), stored_tasks(pairs))


def document_topics(spark: SparkSession, sf: str) -> DataFrame:
    """(service, topic, producers, consumers) as result documents list them."""
    role = F.col("role")
    return members(spark, sf).groupBy("service", "topic").agg(
        F.collect_list(F.when(role == "producer", F.col("service"))).alias("producers"),
        F.collect_list(F.when(role == "consumer", F.col("service"))).alias("consumers"),
    )
