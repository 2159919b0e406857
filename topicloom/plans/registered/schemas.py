"""C1-C6, F7."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import schemas as c
from topicloom.operators.skew import shuffled
from topicloom.plans import corpora
from topicloom.plans.corpora import table
from topicloom.plans.registered import shared
from topicloom.plans.registered.base import USES, query


@query(
    "c1_avro_schemas",
    """SELECT 'schemas/' || p_brand || '/Part' || p_partkey || '.avsc' AS path, 'Part' || p_partkey AS schema,
              'avro' AS type, 'shop.' || lower(p_type) AS namespace, 8 AS n_fields
       FROM part WHERE p_size > 10""",
)
def avro_schemas(spark, sf):
    found = c.avro_schemas(corpora.part_avsc(table(spark, sf, "part")))
    return found.withColumn("n_fields", F.size("fields")).drop("fields")


@query(
    "c2_normalize_field_type",
    """SELECT 'Part' || p_partkey AS schema, pos, field, CASE field WHEN 'meta' THEN 'Meta' || p_partkey WHEN 'deep' THEN repeat('array(', p_size) || 'int' || repeat(')', p_size) ELSE field_type END AS field_type
       FROM part, (VALUES (0, 'stamp', 'long'), (1, 'data', 'string'), (2, 'size', 'union(string,int)'), (3, 'tags', 'array(string)'),
                          (4, 'grid', 'array(array(int))'), (5, 'meta', ''), (6, 'deep', ''), (7, 'id', 'bytes')) f(pos, field, field_type)
       WHERE p_size > 10""",
)
def normalize_field_type(spark, sf):
    found = c.avro_schemas(corpora.part_avsc(table(spark, sf, "part")))
    return c.schema_fields(found).select("schema", "pos", "field", "field_type")


@query(
    "c3_generated_classes",
    """SELECT 'Part' || p_partkey AS schema, 'shop.parts' AS namespace, pos, field, field_type
       FROM part, (VALUES (0, 'DOC', 'string'), (1, 'name', 'string'), (2, 'label', 'string'), (3, 'size', 'int'),
                          (4, 'tags', 'List<string>'), (5, 'counts', 'object'), (6, 'brands', 'array(object)'), (7, 'total', 'long')) f(pos, field, field_type)""",
)
def generated_classes(spark, sf):
    found = c.generated_classes(corpora.class_files(table(spark, sf, "part")))
    return c.schema_fields(found).select("schema", "namespace", "pos", "field", "field_type")


@query(
    "c4_registry_refs",
    """SELECT 'svc-' || p_partkey || '/src/Refs.java' AS path, 'http://localhost:8081/subjects/part-' || p_partkey || '/versions/latest' AS url,
              'part-' || p_partkey AS subject, 'latest' AS version FROM part
       UNION ALL SELECT 'svc-' || p_partkey || '/src/Refs.java', 'http://registry:8081/subjects/part-' || p_partkey || '/versions/' || p_size,
              'part-' || p_partkey, CAST(p_size AS VARCHAR) FROM part""",
)
def registry_refs(spark, sf):
    return c.registry_refs(corpora.reference_files(table(spark, sf, "part")))


@query(
    "c4_registry_schemas",
    """SELECT 'svc-' || p_partkey || '/src/Refs.java' AS path, 'Reg' || p_partkey AS schema, 'reg' AS namespace,
              CASE v WHEN 'old' THEN 'id,size,note' ELSE 'id,size,color' || CASE WHEN p_size > 25 THEN '' ELSE ',note' END END AS fields
       FROM part, (VALUES ('old'), ('new')) t(v)""",
)
def registry_schemas(spark, sf):
    part = table(spark, sf, "part")
    refs = c.registry_refs(corpora.reference_files(part))
    found = c.registry_schemas(refs, corpora.registry_snapshot(part))
    names = F.array_join(F.transform("fields", lambda f: f["name"]), ",")
    return found.select("path", "schema", "namespace", names.alias("fields"))


@query(
    "c5_merge_schemas",
    """WITH k AS (SELECT l_suppkey AS s, l_partkey AS p, bool_or(l_linenumber = 1) AS cls, bool_or(l_linenumber = 2) AS reg
                  FROM lineitem GROUP BY ALL)
       SELECT 'svc-' || s AS service, 'Part' || p AS schema,
              CASE WHEN reg THEN 'registry' WHEN cls THEN 'classes' ELSE 'avsc' END AS namespace FROM k""",
)
def merge_schemas(spark, sf):
    """Every pair has a document; first lines add a class, second lines a registry
    reference of the same name."""
    lines = table(spark, sf, "lineitem").select(
        corpora.fill("svc-<s>", s="l_suppkey").alias("service"),
        corpora.fill("Part<p>", p="l_partkey").alias("schema"),
        F.lit("avro").alias("type"),
        corpora.fill("svc-<s>/Part<p>", s="l_suppkey", p="l_partkey").alias("path"),
        F.array().cast(c.FIELDS).alias("fields"),
        "l_linenumber",
    )

    def kind(rows, namespace):
        return rows.select("service", "schema", "type", F.lit(namespace).alias("namespace"), "path", "fields")

    return c.merge_schemas(
        kind(lines, "avsc"),
        kind(lines.where("l_linenumber = 1"), "classes"),
        kind(lines.where("l_linenumber = 2"), "registry"),
    ).select("service", "schema", "namespace")


@query(
    "c6_schema_diff",
    """SELECT 'Reg' || p_partkey AS schema, 'size' AS field, 'retyped' AS change, 'int' AS old_type, 'long' AS new_type FROM part
       UNION ALL SELECT 'Reg' || p_partkey, 'color', 'added', NULL, 'string' FROM part
       UNION ALL SELECT 'Reg' || p_partkey, 'note', 'removed', 'string', NULL FROM part WHERE p_size > 25""",
)
def schema_diff(spark, sf):
    part = table(spark, sf, "part")
    snapshot = corpora.registry_snapshot(part)
    latest = snapshot.groupBy("subject").agg(F.max("version").alias("newest"))
    dated = snapshot.join(shuffled(latest), "subject").withColumn("is_new", F.col("version") == F.col("newest"))
    fields = c.schema_fields(c.parse_records(dated, "schema", ["is_new"]))
    return c.schema_diff(fields.where(~F.col("is_new")), fields.where("is_new"))


@query(
    "f7_search_schemas",
    f"""WITH {USES} SELECT schema, namespace, service FROM uses WHERE schema IN
        (SELECT schema FROM uses WHERE contains(schema, '11') OR contains(namespace, '11') OR contains(service, '11'))""",
)
def search_schemas(spark, sf):
    return c.search_schemas(shared.party_schemas(spark, sf), "11")
