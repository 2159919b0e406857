"""S2-S4, G1-G8, P10-P18, I1, U2 and the whole analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import extraction, topics, views
from topicloom.operators import graph as g
from topicloom.operators.services import assign_files
from topicloom.operators.skew import stored_tasks
from topicloom.plans import analyze, corpora
from topicloom.plans.corpora import fill, table
from topicloom.plans.registered import shared
from topicloom.plans.registered.base import (
    EDGES, HITS, MEMBERS, ROLES, SERVICES, USES, member_rows, query,
)
from topicloom.session import materialize, scratch_path
from topicloom.sources import documents
from topicloom.streaming import incremental, store


# --- merging and totals ----------------------------------------------------


@query("g1_merge_topics", f"WITH {ROLES} SELECT service, topic, role, path, line, col FROM roles")
def merge_topics(spark, sf):
    return shared.roles(spark, sf)


@query(
    "g1_topic_counts",
    f"""WITH {ROLES} SELECT service, topic, count(*) FILTER (role = 'producer') AS producer_locations,
               count(*) FILTER (role = 'consumer') AS consumer_locations FROM roles GROUP BY ALL""",
)
def topic_counts(spark, sf):
    return topics.topic_counts(shared.roles(spark, sf))


@query(
    "g2_global_topics",
    f"""WITH {MEMBERS} SELECT topic, service, bool_or(role = 'producer') AS is_producer,
               bool_or(role = 'consumer') AS is_consumer FROM members GROUP BY ALL""",
)
def global_topics(spark, sf):
    return topics.global_topics(shared.members(spark, sf))


@query(
    "g2_global_topic_lists",
    f"""WITH {MEMBERS} SELECT topic, role, service,
               row_number() OVER (PARTITION BY topic, role ORDER BY service) - 1 AS pos FROM members""",
)
def global_topic_lists(spark, sf):
    return topics.global_topic_lists(shared.members(spark, sf))


@query(
    "g3_analysis_summary",
    f"""WITH {MEMBERS}, {USES} SELECT (SELECT count(*) FROM customer) AS services,
               (SELECT count(*) FROM (SELECT DISTINCT service, topic FROM members)) AS topics,
               (SELECT count(*) FROM uses) AS schemas""",
)
def analysis_summary(spark, sf):
    return topics.analysis_summary(
        shared.found_services(spark, sf), shared.members(spark, sf), shared.party_schemas(spark, sf)
    )


@query(
    "g4_index_stats",
    f"""WITH {MEMBERS}, {USES} SELECT (SELECT count(*) FROM customer) AS services,
               (SELECT count(DISTINCT topic) FROM members) AS topics,
               (SELECT count(DISTINCT schema) FROM uses) AS schemas""",
)
def index_stats(spark, sf):
    return topics.index_stats(
        shared.found_services(spark, sf), shared.members(spark, sf), shared.party_schemas(spark, sf)
    )


@query(
    "g5_schema_usage",
    f"""WITH {USES} SELECT schema, 'avro' AS type, arg_min(namespace, service) AS namespace,
               count(*) AS n_services FROM uses GROUP BY schema""",
)
def schema_usage(spark, sf):
    uses = shared.stored_schemas(spark, sf)
    return topics.schema_usage(uses, stored_tasks(uses))


@query(
    "g5_schema_service_lists",
    f"""WITH {USES} SELECT schema, service,
               row_number() OVER (PARTITION BY schema ORDER BY service) - 1 AS pos FROM uses""",
)
def schema_service_lists(spark, sf):
    return topics.schema_service_lists(shared.party_schemas(spark, sf))


def _result_documents(spark, sf):
    """A result document per order: its own topic with listed and empty names, a
    topic without roles, and entries of a wrong shape."""
    content = fill(
        '{"services": {"svc-<c>": {"language": "java", "path": "svc-<c>", "topics": {'
        '"order-<o>": {"producers": ["svc-1", "", "svc-2"], "consumers": ["svc-<c>"]},'
        ' "idle-<o>": {"producers": [], "consumers": [""]}, "bad": "text"},'
        ' "schemas": {"S<o>": {"type": "avro", "namespace": "n<c>"}}}, "broken": 1}}',
        c="o_custkey", o="o_orderkey",
    )
    bare = fill(
        '{"svc-<c>": {"topics": {"order-<o>": {"consumers": ["svc-<c>", "x"]}}, "schemas": {"S<o>": {}}}}',
        c="o_custkey", o="o_orderkey",
    )
    doc = F.when(F.col("o_orderstatus") == "P", bare).otherwise(content)
    return table(spark, sf, "orders").select(doc.alias("content"))


@query(
    "s2_scan_analysis",
    """SELECT 'svc-' || o_custkey AS service, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'java' END AS language,
              'order-' || o_orderkey AS topic,
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'svc-1||svc-2' END AS producers,
              CASE WHEN o_orderstatus = 'P' THEN 'svc-' || o_custkey || '|x' ELSE 'svc-' || o_custkey END AS consumers,
              'S' || o_orderkey AS schema, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE 'avro' END AS type,
              CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'n' || o_custkey END AS namespace
       FROM orders""",
)
def scan_analysis(spark, sf):
    got = documents.parse_analysis(_result_documents(spark, sf))
    order = F.regexp_extract("topic", "^order-(.*)$", 1)
    listed = got.topics.where(order != "").select(
        "service", "topic", order.alias("key"),
        F.array_join("producers", "|").alias("producers"),
        F.array_join("consumers", "|").alias("consumers"),
    )
    schemas = got.schemas.withColumn("key", F.substring("schema", 2, 99)).drop("service")
    named = got.services.select("service", "language", F.col("path").isNull().alias("bare")).distinct()
    joined = listed.join(schemas, "key").withColumn("bare", F.col("type") == "unknown")
    return joined.join(named, ["service", "bare"]).select(
        "service", "language", "topic", "producers", "consumers", "schema", "type", "namespace"
    )


@query(
    "g6_topic_roles_in_result",
    """SELECT 'order-' || o_orderkey AS topic, 'svc-' || o_custkey AS service, 'producer' AS role, 2 AS n
       FROM orders WHERE o_orderstatus <> 'P'
       UNION ALL SELECT 'order-' || o_orderkey, 'svc-' || o_custkey, 'consumer',
                        CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END FROM orders""",
)
def topic_roles_in_result(spark, sf):
    got = documents.parse_analysis(_result_documents(spark, sf))
    return topics.topic_roles_in_result(got.topics)


@query(
    "g7_extraction_stats",
    f"""WITH {ROLES}, files AS (SELECT 'svc-' || l_suppkey AS service, count(*) AS n FROM lineitem GROUP BY 1
            UNION ALL SELECT 'svc-' || o_custkey, count(*) FROM orders GROUP BY 1),
        per AS (SELECT service, sum(n) AS files FROM files GROUP BY 1),
        found AS (SELECT service, count(DISTINCT topic) AS topics, count(*) AS locations FROM roles GROUP BY 1)
        SELECT service, CAST(files AS BIGINT) AS files, topics, locations FROM per JOIN found USING (service)""",
)
def extraction_stats(spark, sf):
    owned = assign_files(
        corpora.trade_files(spark, sf).select("path"), shared.found_services(spark, sf)
    )
    return topics.extraction_stats(owned, shared.roles(spark, sf))


@query(
    "g7_analyzer_stats",
    f"""WITH {HITS} SELECT analyzer, count(DISTINCT pattern) AS patterns, count(DISTINCT path) AS files,
               count(*) AS matches FROM hits GROUP BY analyzer""",
)
def analyzer_stats(spark, sf):
    return topics.analyzer_stats(extraction.topic_facts(corpora.trade_files(spark, sf), locate=False))


@query(
    "g8_group_by_service_topic",
    f"""WITH {ROLES} SELECT service, topic, count(*) FILTER (role = 'producer') AS produces,
               count(*) FILTER (role = 'consumer') AS consumes
        FROM roles GROUP BY GROUPING SETS ((service), (topic), (service, topic))""",
)
def group_by_service_topic(spark, sf):
    return topics.group_by_service_topic(shared.roles(spark, sf))


# --- documents and graph tables --------------------------------------------


@query(
    "s3_write_analysis",
    f"""WITH {SERVICES}, {MEMBERS} SELECT s.service, s.language, topic,
               CASE WHEN bool_or(role = 'producer') THEN s.service ELSE '' END AS producers,
               CASE WHEN bool_or(role = 'consumer') THEN s.service ELSE '' END AS consumers
        FROM services s JOIN members m ON s.service = m.service GROUP BY s.service, s.language, topic""",
)
def write_analysis(spark, sf):
    services = materialize(shared.found_services(spark, sf), "services")
    docs = documents.analysis_documents(
        services, shared.stored_roles(spark, sf), shared.stored_schemas(spark, sf)
    )
    # two tables are made of the documents, which are parsed once
    bodies = materialize(documents.service_bodies(materialize(docs, "documents"), "document"), "bodies")
    got = documents.analysis_tables(bodies)
    return got.topics.join(got.services.select("service", "language").distinct(), "service").select(
        "service", "language", "topic",
        F.array_join("producers", ",").alias("producers"),
        F.array_join("consumers", ",").alias("consumers"),
    )


NODES = f"""{SERVICES}, {MEMBERS},
named AS (SELECT service AS name, 'service' AS type, language, CAST(0 AS BIGINT) AS n_producers, CAST(0 AS BIGINT) AS n_consumers
          FROM services
          UNION ALL SELECT topic, 'topic', NULL, count(*) FILTER (role = 'producer'), count(*) FILTER (role = 'consumer')
          FROM members GROUP BY topic),
nodes AS (SELECT row_number() OVER (ORDER BY type, name) - 1 AS id, * FROM named)"""
LINKS = f"""{NODES},
links AS (SELECT CASE WHEN role = 'producer' THEN s.id ELSE t.id END AS source,
                 CASE WHEN role = 'producer' THEN t.id ELSE s.id END AS target,
                 CASE WHEN role = 'producer' THEN 'produces' ELSE 'consumes' END AS type
          FROM members m JOIN nodes s ON s.type = 'service' AND s.name = m.service
          JOIN nodes t ON t.type = 'topic' AND t.name = m.topic)"""


def _nodes(spark, sf, members):
    return views.viz_nodes(shared.found_services(spark, sf), members)


@query(
    "s4_write_graph",
    f"""WITH {LINKS}, {USES} SELECT (SELECT count(*) FROM nodes) AS nodes_count,
               (SELECT count(*) FROM links) AS links_count,
               (SELECT count(DISTINCT schema) FROM uses) AS schemas_count""",
)
def write_graph(spark, sf):
    members = shared.stored_members(spark, sf)
    nodes = _nodes(spark, sf, members)
    links = views.viz_links(nodes, members)
    schemas = topics.schema_usage(shared.party_schemas(spark, sf))
    return documents.write_graph(nodes, links, schemas, scratch_path(spark, "graph")).drop("generated_at")


@query("p10_viz_nodes", f"WITH {NODES} SELECT * FROM nodes")
def viz_nodes(spark, sf):
    return _nodes(spark, sf, shared.members(spark, sf))


@query("p11_viz_links", f"WITH {LINKS} SELECT * FROM links")
def viz_links(spark, sf):
    members = shared.stored_members(spark, sf)
    return views.viz_links(_nodes(spark, sf, members), members)


CLEAN_MEMBERS = """clean AS (SELECT replace(service, '-', '_') AS service, 'topic_' || replace(topic, '-', '_') AS topic, role FROM members)"""


@query(
    "p12_diagram_edges",
    f"""WITH {MEMBERS}, {USES}, {CLEAN_MEMBERS}
        SELECT service AS source, topic AS target, 'produces' AS kind FROM clean WHERE role = 'producer'
        UNION SELECT topic, service, 'consumes' FROM clean WHERE role = 'consumer'
        UNION SELECT replace(service, '-', '_'), 'schema_' || schema, 'uses' FROM uses""",
)
def diagram_edges(spark, sf):
    return views.diagram_edges(shared.document_topics(spark, sf), shared.party_schemas(spark, sf))


@query(
    "p12_diagram_nodes",
    f"""WITH {SERVICES}, {MEMBERS}, {USES}
        SELECT replace(service, '-', '_') AS node_id, service AS label, 'service' AS kind FROM services
        UNION SELECT 'topic_' || replace(topic, '-', '_'), topic, 'topic' FROM members
        UNION SELECT 'schema_' || schema, schema, 'schema' FROM uses""",
)
def diagram_nodes(spark, sf):
    return views.diagram_nodes(
        shared.found_services(spark, sf), shared.members(spark, sf), shared.party_schemas(spark, sf)
    )


@query(
    "p13_clean_node_id",
    """SELECT p_partkey, 'at' || replace(p_name, ' ', '_') || '_hash' || p_size || '_' || p_partkey || '$' AS node_id FROM part
       UNION ALL SELECT -1 - p_partkey, 'topic_hash' FROM part""",
)
def clean_node_id(spark, sf):
    part = table(spark, sf, "part")
    name = fill("@<n>.#<s>-${<p>}$", n="p_name", s="p_size", p="p_partkey")
    return part.select("p_partkey", text.clean_node_id(name).alias("node_id")).union(
        part.select((-1 - F.col("p_partkey")), text.clean_node_id(F.lit("#{")))
    )


@query(
    "p13_node_id_collisions",
    """SELECT replace(p_name, ' ', '_') || '_' || p_size AS node_id, count(DISTINCT p_name || CASE WHEN p_partkey < 1000 THEN '.' ELSE '-' END || p_size) AS n
       FROM part GROUP BY 1 HAVING n > 1""",
)
def node_id_collisions(spark, sf):
    name = fill(
        "<n><c><s>", n="p_name", s="p_size",
        c=F.when(F.col("p_partkey") < 1000, ".").otherwise("-"),
    )
    return views.node_id_collisions(table(spark, sf, "part").select(name.alias("name")), "name")


@query(
    "p14_format_topic_name",
    """SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'kafka.streams...part' || p_partkey WHEN p_size <= 20 THEN 'app...part' || p_partkey
                WHEN p_size <= 25 THEN 'app...last' || p_partkey WHEN p_size <= 30 THEN 'kafka.streams...target'
                WHEN p_size <= 40 THEN 'config.kafka...part' || p_partkey ELSE 'part.' || p_partkey END AS label FROM part""",
)
def format_topic_name(spark, sf):
    size = F.col("p_size")
    topic = (
        F.when(size <= 10, fill("${my.kafka.streams.part<p>}", p="p_partkey"))
        .when(size <= 20, fill("app.x.event.part<p>.y", p="p_partkey"))
        .when(size <= 25, fill("app.x.last<p>", p="p_partkey"))
        .when(size <= 30, F.lit("kafka.streams.target-topic"))
        .when(size <= 40, fill("${config.a.part<p>}", p="p_partkey"))
        .otherwise(fill("part.<p>", p="p_partkey"))
    )
    return table(spark, sf, "part").select("p_partkey", text.format_topic_name(topic).alias("label"))


@query(
    "p15_service_details",
    f"""WITH {SERVICES}, {MEMBERS}, {USES},
        t AS (SELECT service, count(*) FILTER (role = 'producer') AS np, count(*) FILTER (role = 'consumer') AS nc FROM members GROUP BY 1),
        u AS (SELECT service, count(*) AS ns FROM uses GROUP BY 1)
        SELECT service, language, coalesce(np, 0) AS n_produced, coalesce(nc, 0) AS n_consumed, coalesce(ns, 0) AS n_schemas
        FROM services LEFT JOIN t USING (service) LEFT JOIN u USING (service)""",
)
def service_details(spark, sf):
    return views.service_details(
        shared.found_services(spark, sf), shared.members(spark, sf), shared.party_schemas(spark, sf)
    )


@query(
    "p15_service_items",
    f"""WITH {MEMBERS}, {USES}
        SELECT service, CASE role WHEN 'producer' THEN 'produces' ELSE 'consumes' END AS section, topic AS item,
               NULL AS type, NULL AS namespace FROM members
        UNION ALL SELECT service, 'schemas', schema, type, namespace FROM uses""",
)
def service_items(spark, sf):
    return views.service_items(shared.members(spark, sf), shared.party_schemas(spark, sf))


@query(
    "p16_topic_details",
    f"""WITH {MEMBERS} SELECT topic, count(*) FILTER (role = 'producer') AS n_producers,
               count(*) FILTER (role = 'consumer') AS n_consumers FROM members GROUP BY topic""",
)
def topic_details(spark, sf):
    return views.topic_details(shared.members(spark, sf))


@query(
    "p17_schema_neighbourhood",
    f"""WITH {MEMBERS}, {USES}, s AS (SELECT service FROM uses WHERE schema = 'Part7'),
        l AS (SELECT * FROM members WHERE service IN (SELECT service FROM s))
        SELECT 'service' AS kind, service, NULL AS topic, NULL AS role FROM s
        UNION ALL SELECT DISTINCT 'topic', NULL, topic, NULL FROM l
        UNION ALL SELECT 'link', service, topic, role FROM l""",
)
def schema_neighbourhood(spark, sf):
    return views.schema_neighbourhood(
        shared.party_schemas(spark, sf), shared.stored_members(spark, sf), "Part7"
    )


@query(
    "p18_architecture_rows",
    f"""WITH {SERVICES}, {MEMBERS}, t AS (
          SELECT service, topic, CASE WHEN bool_or(role = 'producer') THEN service ELSE 'None' END AS producers,
                 CASE WHEN bool_or(role = 'consumer') THEN service ELSE 'None' END AS consumers
          FROM members GROUP BY service, topic)
        SELECT service, language, topic, producers, consumers FROM services LEFT JOIN t USING (service)""",
)
def architecture_rows(spark, sf):
    return views.architecture_rows(shared.found_services(spark, sf), shared.document_topics(spark, sf))


@query(
    "p18_architecture_schemas",
    f"""WITH {SERVICES}, {USES} SELECT service, schema, type, namespace FROM services LEFT JOIN uses USING (service)""",
)
def architecture_schemas(spark, sf):
    return views.architecture_schemas(
        shared.found_services(spark, sf), shared.party_schemas(spark, sf)
    )


# --- whole analyses --------------------------------------------------------

ALL_MEMBERS = f"""{member_rows('producer', 'consumer')}
      UNION SELECT 'svc-' || c_custkey, CASE WHEN r = 'producer' THEN 'ship-' ELSE 'bill-' END || c_nationkey, r
      FROM customer, (VALUES ('producer'), ('consumer')) v(r) WHERE c_custkey IN (SELECT o_custkey FROM orders)
                                                                 OR c_custkey IN (SELECT s_suppkey FROM supplier)"""


def _facts(spark, sf):
    return analyze.analyze(corpora.corpus(spark, sf))


@query("analysis_members", f"WITH members AS ({ALL_MEMBERS}) SELECT service, topic, role FROM members")
def analysis_members(spark, sf):
    return topics.topic_members(_facts(spark, sf).roles)


@query(
    "analysis_services",
    f"""WITH {SERVICES} SELECT service, language, false AS is_stub FROM services
        UNION ALL SELECT 'nation-' || c_nationkey, 'unknown', true FROM customer WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY c_nationkey
        UNION ALL SELECT 'nation-' || c_nationkey || '-api', 'unknown', true FROM customer WHERE c_mktsegment = 'HOUSEHOLD' GROUP BY c_nationkey
        UNION ALL SELECT 'region-client', 'unknown', true WHERE EXISTS (FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
        UNION ALL SELECT 'shop-nation-' || c_nationkey || '-client', 'unknown', true FROM customer WHERE c_mktsegment = 'FURNITURE' GROUP BY c_nationkey
        UNION ALL SELECT 'mock-api', 'unknown', true WHERE EXISTS (FROM customer WHERE c_mktsegment = 'FURNITURE')""",
)
def analysis_services(spark, sf):
    return _facts(spark, sf).services.select("service", "language", "is_stub")


def _hub_topics(facts):
    """Topics that some service produces and another consumes, by fan-out."""
    return g.topic_fan_out(topics.topic_members(facts.roles))


@query(
    "u2_service_analysis",
    f"""WITH {EDGES} SELECT topic, count(DISTINCT target) AS fan_out FROM topic_edges GROUP BY topic""",
)
def service_analysis(spark, sf):
    plugins = analyze.Plugins()
    plugins.register("hub_topics", _hub_topics)
    plugins.register("failing", lambda facts: facts.roles.select("no_such_column"))
    files = corpora.trade_files(spark, sf).union(corpora.build_files(table(spark, sf, "customer")))
    return plugins.run(analyze.analyze(files)).extra["hub_topics"]


@query(
    "i1_incremental_extract",
    """SELECT DISTINCT 'svc-' || l_suppkey AS service, 'order-' || l_orderkey AS topic, 'producer' AS role FROM lineitem
       UNION SELECT 'svc-' || l_suppkey, 'urgent-' || l_orderkey, 'producer' FROM lineitem
             WHERE l_quantity >= 48 AND l_linenumber > 1""",
)
def incremental_extract(spark, sf):
    """All files arrive; then those of first lines come again, no longer urgent."""
    lines = table(spark, sf, "lineitem")
    folder, store, progress = (scratch_path(spark, x) for x in ("arriving", "facts", "progress"))
    for rows in (lines, lines.where("l_linenumber = 1").withColumn("l_quantity", F.lit(0.0))):
        rows.write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(lines.schema).parquet(folder)
        incremental.start_extract(corpora.line_files(arriving), store, progress, locate=False).awaitTermination()
    facts = incremental.current_facts(spark, store)
    return facts.select(
        F.substring_index("path", "/", 1).alias("service"), "topic", "role"
    ).distinct()


BATCHES = """SELECT 'svc-' || l_suppkey AS service, 'order-' || l_orderkey AS topic, 'producer' AS role, l_orderkey, l_linenumber
             FROM lineitem WHERE l_linenumber <> 2
             UNION ALL SELECT 'svc-' || l_suppkey, 'urgent-' || l_orderkey, 'producer', l_orderkey, l_linenumber FROM lineitem
             WHERE l_quantity >= 48 AND l_linenumber > 2"""


def _three_batches(spark, sf):
    """All files arrive; then those of first lines again, no longer urgent; then those of second lines go.
    Yields after each batch what has arrived as a stream of texts."""
    lines = table(spark, sf, "lineitem")
    folder = scratch_path(spark, "arriving")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in lines.schema)}, removed boolean"
    batches = (
        lines.withColumn("removed", F.lit(False)),
        lines.where("l_linenumber = 1").withColumn("l_quantity", F.lit(0.0)).withColumn("removed", F.lit(False)),
        lines.where("l_linenumber = 2").withColumn("removed", F.lit(True)),
    )
    for rows in batches:
        rows.write.mode("append").parquet(folder)
        arriving = spark.readStream.schema(schema).parquet(folder)
        gone = corpora.line_files(arriving.where("removed")).withColumn("content", F.lit(None).cast("string"))
        yield corpora.line_files(arriving.where("NOT removed")).unionByName(gone)


@query("i1_bucketed_store", f"SELECT DISTINCT service, topic, role FROM ({BATCHES})")
def bucketed_store(spark, sf):
    facts, progress = scratch_path(spark, "store"), scratch_path(spark, "progress")
    kept = store.FactStore(spark, facts, buckets=16)
    for texts in _three_batches(spark, sf):
        store.start_store(texts, kept, progress, locate=False).awaitTermination()
    return kept.facts().select(F.substring_index("path", "/", 1).alias("service"), "topic", "role").distinct()


@query("i1_running_totals", f"SELECT topic, role, count(*) AS files FROM ({BATCHES}) GROUP BY topic, role")
def running_totals(spark, sf):
    facts, progress, totals, seen = (scratch_path(spark, x) for x in ("store", "progress", "totals", "seen"))
    kept = store.FactStore(spark, facts, buckets=16)
    for texts in _three_batches(spark, sf):
        store.start_store(texts, kept, progress, locate=False).awaitTermination()
        store.start_totals(spark, kept, totals, seen).awaitTermination()
    return store.current_totals(spark, totals)
