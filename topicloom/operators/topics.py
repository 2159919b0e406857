"""Topic roles: merging, totals and filters.

``roles`` is the fact table (service, topic, role, path, line, col);
``members`` is its distinct (service, topic, role).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.services import assign_files
from topicloom.operators.numbering import numbered_lists
from topicloom.operators.skew import SALTS

ROLE_COLUMNS = ("service", "topic", "role", "path", "line", "col")


def topic_roles(facts: DataFrame, services: DataFrame) -> DataFrame:
    """G1 from extracted facts: owned by a service, merged over files and analysers."""
    return merge_topics(assign_files(facts.where(F.col("role").isNotNull()), services))


def merge_topics(*parts: DataFrame) -> DataFrame:
    """G1: union of all roles and locations of the same topic. The distinct key is
    the whole location, so a hot topic is spread like any other rows."""
    out = parts[0].select(*ROLE_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*ROLE_COLUMNS))
    return out.distinct()


def topic_members(roles: DataFrame) -> DataFrame:
    """Distinct (service, topic, role); takes any owned facts, merged or not."""
    return roles.select("service", "topic", "role").distinct()


def topic_counts(roles: DataFrame) -> DataFrame:
    """(service, topic, producer_locations, consumer_locations)."""
    return roles.groupBy("service", "topic").agg(
        F.count_if(F.col("role") == "producer").alias("producer_locations"),
        F.count_if(F.col("role") == "consumer").alias("consumer_locations"),
    )


def global_topics(members: DataFrame) -> DataFrame:
    """(topic, service, is_producer, is_consumer) over all services."""
    return members.groupBy("topic", "service").agg(
        F.max(F.col("role") == "producer").alias("is_producer"),
        F.max(F.col("role") == "consumer").alias("is_consumer"),
    )


def global_topic_lists(members: DataFrame) -> DataFrame:
    """G2 nested, as rows: (topic, role, pos, service), services numbered in order."""
    return numbered_lists(members.select("topic", "role", "service"), ["topic", "role"], "service")


def analysis_summary(services: DataFrame, topics: DataFrame, schemas: DataFrame) -> DataFrame:
    """Services, and topics and schemas summed per service."""
    return _totals(
        services.agg(F.countDistinct("service").alias("services")),
        topics.agg(F.countDistinct("service", "topic").alias("topics")),
        schemas.agg(F.countDistinct("service", "schema").alias("schemas")),
    )


def index_stats(services: DataFrame, topics: DataFrame, schemas: DataFrame) -> DataFrame:
    """Services, distinct topics and distinct schemas."""
    return _totals(
        services.agg(F.countDistinct("service").alias("services")),
        topics.agg(F.countDistinct("topic").alias("topics")),
        schemas.agg(F.countDistinct("schema").alias("schemas")),
    )


def _totals(*ones: DataFrame) -> DataFrame:
    """Several one-row frames side by side, by union and a last aggregate."""
    out = ones[0]
    for o in ones[1:]:
        out = out.unionByName(o, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def schema_usage(schemas: DataFrame, tasks: int | None = None) -> DataFrame:
    """(schema, type, namespace, n_services); the first service in name order
    gives type and namespace.

    Uses are merged by schema and a salt of the service, then by schema: a popular schema is
    spread, and the uses move once. ``tasks`` cuts them into so many parts.
    """
    salted = schemas.select("schema", "service", "type", "namespace").withColumn("_salt", F.pmod(F.xxhash64("service"), F.lit(SALTS)))
    if tasks:
        salted = salted.repartition(tasks, "schema", "_salt")
    uses = salted.groupBy("schema", "_salt", "service").agg(F.first(F.struct("type", "namespace")).alias("first"))
    parts = uses.groupBy("schema", "_salt").agg(
        F.min_by("first", "service").alias("first"), F.min("service").alias("service"), F.count("service").alias("n")
    )
    return (
        parts.groupBy("schema")
        .agg(F.min_by("first", "service").alias("first"), F.sum("n").alias("n_services"))
        .select("schema", "first.type", "first.namespace", "n_services")
    )


def schema_service_lists(schemas: DataFrame) -> DataFrame:
    """G5 nested, as rows: (schema, pos, service), services numbered in order."""
    return numbered_lists(schemas.select("schema", "service").distinct(), ["schema"], "service")


def topic_roles_in_result(topics: DataFrame) -> DataFrame:
    """From result documents (service, topic, producers, consumers): one entry
    of the owning service per listed name. ``n`` keeps the multiplicity; empty
    names are skipped, and a topic without any entry vanishes."""

    def entries(names: str, role: str) -> Column:
        kept = F.filter(F.col(names), lambda x: x != "")
        return F.struct(F.lit(role).alias("role"), F.size(kept).alias("n"))

    both = F.array(entries("producers", "producer"), entries("consumers", "consumer"))
    return (
        topics.select("topic", "service", F.explode(both).alias("e"))
        .where(F.col("e.n") > 0)
        .groupBy("topic", "service", "e.role")
        .agg(F.sum("e.n").alias("n"))
    )


def extraction_stats(service_files: DataFrame, roles: DataFrame) -> DataFrame:
    """Per service files analysed, topics found and locations."""
    files = service_files.groupBy("service").agg(
        F.count(F.lit(1)).alias("files")
    )
    found = roles.groupBy("service").agg(
        F.countDistinct("topic").alias("topics"), F.count(F.lit(1)).alias("locations")
    )
    none = {"files": 0, "topics": 0, "locations": 0}
    return files.join(found, "service", "full").na.fill(none)


def analyzer_stats(facts: DataFrame) -> DataFrame:
    """Per analyser patterns that hit, files with hits and matches."""
    return facts.groupBy("analyzer").agg(
        F.countDistinct("pattern").alias("patterns"),
        F.countDistinct("path").alias("files"),
        F.count(F.lit(1)).alias("matches"),
    )


def group_by_service_topic(roles: DataFrame) -> DataFrame:
    """Totals by service, by topic and by both."""
    return roles.groupingSets(
        [["service"], ["topic"], ["service", "topic"]], "service", "topic"
    ).agg(
        F.count_if(F.col("role") == "producer").alias("produces"),
        F.count_if(F.col("role") == "consumer").alias("consumes"),
    )


def glob_to_regex(glob: str) -> str:
    """A path glob as a regex: ``**`` spans directories, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] in "*?":
            out, i = out + ("[^/]*" if glob[i] == "*" else "[^/]"), i + 1
        else:
            out, i = out + (glob[i] if glob[i].isalnum() or glob[i] in "/_" else "\\" + glob[i]), i + 1
    return f"^{out}$"


def filter_topics(
    rows: DataFrame,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    exclude_paths: Iterable[str] = (),
) -> DataFrame:
    """topics found by an include regex, by no exclude regex, and not in a
    path that an exclude glob covers."""
    if include := list(include):
        rows = rows.where(F.rlike("topic", F.lit("|".join(f"(?:{r})" for r in include))))
    if exclude := list(exclude):
        rows = rows.where(~F.rlike("topic", F.lit("|".join(f"(?:{r})" for r in exclude))))
    if globs := [glob_to_regex(g) for g in exclude_paths]:
        rows = rows.where(~F.rlike("path", F.lit("|".join(globs))))
    return rows
