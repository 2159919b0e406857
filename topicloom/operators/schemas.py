"""Message schemas (C1-C6) and schema search.

``schemas`` is (path, schema, type, namespace, fields) with fields an
array<struct<name,type>> in file order; ``owned`` adds the service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.functions import text
from topicloom.functions.avro import normalize_field_type, normalize_java_type
from topicloom.operators.services import assign_files
from topicloom.operators.skew import salted_join, shuffled
from topicloom.session import materialize

RECORD = "type string, name string, namespace string, fields array<struct<name: string, type: string>>"
FIELDS = "array<struct<name: string, type: string>>"

AVSC, CLASS, REGISTRY = 1, 2, 3


def _last_per_name(fields: Column) -> Column:
    """A name declared twice keeps its last type. The list is bound to a variable
    first: an expression inside a lambda would be worked out again per element."""

    def without_later(all_fields: Column) -> Column:
        return F.filter(
            all_fields,
            lambda f, i: ~F.exists(
                F.slice(all_fields, i + 2, F.size(all_fields)), lambda g: g["name"] == f["name"]
            ),
        )

    return F.get(F.transform(F.array(fields), without_later), 0)


def parse_records(docs: DataFrame, content: str, keep: list[str]) -> DataFrame:
    """Record schemas of JSON documents; bad JSON and other types drop out.

    The generator makes the record a value that is worked out once; a plain projection would be
    parsed again below the filter on its type.
    """
    valid = F.startswith(F.ltrim(F.col(content)), F.lit("{")) & F.try_parse_json(
        content
    ).isNotNull()
    fields = F.transform(
        F.filter("r.fields", lambda f: (f["name"] != "") & (f["type"] != "")),
        lambda f: F.struct(
            f["name"].alias("name"), normalize_field_type(f["type"]).alias("type")
        ),
    )
    return (
        docs.where(valid)
        .select(*keep, F.explode(F.array(F.from_json(content, RECORD))).alias("r"))
        .where(F.col("r.type") == "record")
        .select(
            *keep,
            F.col("r.name").alias("schema"),
            F.lit("avro").alias("type"),
            F.coalesce("r.namespace", F.lit("")).alias("namespace"),
            F.coalesce(_last_per_name(fields), F.array().cast(FIELDS)).alias("fields"),
        )
    )


def avro_schemas(files: DataFrame) -> DataFrame:
    """Record schemas of ``.avsc`` files."""
    return parse_records(files.where(F.endswith("path", F.lit(".avsc"))), "content", ["path"])


def own_level(body: Column) -> Column:
    """What stands in a block itself, given the text behind its opening brace: blocks
    inside it, however deep, become a ``;``, and what follows its closing brace is gone.

    One pass over the pieces between braces, carrying the depth.
    """

    def step(acc: Column, piece: Column) -> Column:
        opens, closes = F.startswith(piece, F.lit("{")), F.startswith(piece, F.lit("}"))
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        ended = acc["ended"] | (depth <= 0)
        plain = F.when(opens | closes, F.substring(piece, 2, 1 << 30)).otherwise(piece)
        mark = F.when(closes, F.lit(";")).otherwise(F.lit(""))
        return F.struct(
            depth.alias("depth"), ended.alias("ended"),
            F.when(~ended & (depth == 1), F.concat(acc["text"], mark, plain)).otherwise(acc["text"]).alias("text"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(False).alias("ended"), F.lit("").alias("text"))
    return F.aggregate(F.split(body, r"(?=[{}])"), start, step, lambda acc: acc["text"])


def generated_classes(files: DataFrame) -> DataFrame:
    """Classes marked as generated from Avro, with their member fields.

    Comments and literals are blanked and inner blocks folded away, so that only
    the class's own members are left; a member without parentheses is a field.
    """
    annotation = r"@(?:org\.apache\.avro\.specific\.)?AvroGenerated\b"
    content = F.col("content")
    marked = files.where(
        text.suffix(F.col("path")).isin(*cat.JVM_SUFFIXES)
        & F.contains(content, F.lit("AvroGenerated"))
        & F.rlike(content, F.lit(annotation))
    )
    blank = F.regexp_replace(
        content, r"""(?s)/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", " "
    )
    header = annotation + r"[^{;]*?\bclass\s+(\w+)[^{]*\{"
    body = F.regexp_extract("text", "(?s)" + header + "(.*)$", 2)
    own = F.split(own_level(body), ";")
    declaration = (
        r"(?s)^\s*(?:@[\w.]+(?:\([^)]*\))?\s+)*"
        r"(?:(?:public|protected|private|static|final|transient|volatile)\s+)*"
        r"(?!(?:abstract|class|interface|enum|record|public|protected|private|static|final)\b)"
        r"([\w.$]+(?:\s*<[^=()]*>)?(?:\s*\[\s*\])*)\s+([\w$][^=()]*)(?:=.*)?$"
    )
    fields = F.flatten(
        F.transform(
            F.filter(own, lambda s: F.rlike(s, F.lit(declaration))),
            lambda s: F.transform(
                F.split(F.regexp_extract(s, declaration, 2), ","),
                lambda n: F.struct(
                    F.regexp_replace(n, r"[\s\[\]]+", "").alias("name"),
                    normalize_java_type(F.regexp_extract(s, declaration, 1)).alias("type"),
                ),
            ),
        )
    )
    return (
        marked.select("path", blank.alias("text"))
        .select(
            "path",
            F.regexp_extract("text", "(?s)" + header, 1).alias("schema"),
            F.lit("avro").alias("type"),
            F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)", 1).alias("namespace"),
            _last_per_name(fields).alias("fields"),
        )
        .where(F.col("schema") != "")
    )


def registry_urls(path: Column, content: Column) -> Column:
    """Distinct registry URLs a source text refers to, by subject or literally."""
    none = F.array().cast("array<string>")
    subjects = F.filter(
        F.regexp_extract_all(content, F.lit(cat.REGISTRY_CALL), 1),
        lambda s: ~F.contains(s, F.lit("/")),
    )
    by_call = F.transform(
        subjects,
        lambda s: F.concat(F.lit(cat.REGISTRY_BASE + "/subjects/"), s, F.lit("/versions/latest")),
    )
    literal = F.regexp_extract_all(content, F.lit(cat.REGISTRY_URL), 0)
    urls = F.concat(
        F.when(F.contains(content, F.lit("/subjects/")), literal).otherwise(none),
        F.when(F.contains(content, F.lit("schemaRegistry.")), by_call).otherwise(none),
    )
    return F.when(text.suffix(path).isin(*cat.REGISTRY_SUFFIXES), F.array_distinct(urls)).otherwise(none)


def registry_refs(files: DataFrame) -> DataFrame:
    """C4: (path, url, subject, version) of schema registry references."""
    urls = registry_urls(F.col("path"), F.col("content"))
    return split_refs(files.select("path", F.explode(urls).alias("url")))


def split_refs(refs: DataFrame) -> DataFrame:
    tail = r"/subjects/([^/]+)/versions/(\w+)$"
    return refs.withColumn("subject", F.regexp_extract("url", tail, 1)).withColumn(
        "version", F.regexp_extract("url", tail, 2)
    )


def registry_schemas(refs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """C4: references resolved against a registry snapshot (subject, version, schema).

    A reference to ``latest`` takes the subject's greatest version.
    """
    latest = snapshot.groupBy("subject").agg(
        F.max_by("schema", "version").alias("json")
    ).select("subject", F.lit("latest").alias("version"), "json")
    numbered = snapshot.select(
        "subject", F.col("version").cast("string").alias("version"), F.col("schema").alias("json")
    )
    found = refs.join(shuffled(numbered.union(latest)), ["subject", "version"])
    return parse_records(found, "json", ["path"])


def owned_schemas(schemas: DataFrame, services: DataFrame, tasks: int | None = None) -> DataFrame:
    """(service, path, schema, type, namespace, fields)."""
    return assign_files(schemas, services, tasks).select(
        "service", "path", "schema", "type", "namespace", "fields"
    )


def merge_schemas(avsc: DataFrame, classes: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per (service, schema): registry over class over ``.avsc``; within
    one kind the last path wins."""
    kinds = ((avsc, AVSC), (classes, CLASS), (registry, REGISTRY))
    ranked = [s.withColumn("rank", F.lit(rank)) for s, rank in kinds]
    every = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    last = F.max_by(F.struct("type", "namespace", "path", "fields"), F.struct("rank", "path"))
    return (
        every.groupBy("service", "schema")
        .agg(last.alias("last"))
        .select("service", "schema", "last.*")
    )


def schema_fields(schemas: DataFrame) -> DataFrame:
    """One row per field, with its 0-based position."""
    keys = [c for c in schemas.columns if c != "fields"]
    return schemas.select(*keys, F.posexplode("fields").alias("pos", "f")).select(
        *keys, "pos", F.col("f.name").alias("field"), F.col("f.type").alias("field_type")
    )


def schema_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("schema",)) -> DataFrame:
    """(keys, field, change, old_type, new_type) of fields added, removed or
    retyped, from two ``schema_fields`` tables."""
    on = [*keys, "field"]
    left = old.select(*on, F.col("field_type").alias("old_type"))
    right = new.select(*on, F.col("field_type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return (
        left.join(right, on, "full")
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(*on, "change", "old_type", "new_type")
    )


def search_schemas(schemas: DataFrame, term: str) -> DataFrame:
    """(schema, namespace, service) uses of schemas whose name, namespace or any
    using service contains the term, whatever its case.

    A hit by service keeps all uses of that schema, so hits are found first and
    joined back by a semi join. The uses are read twice, so they are written first.
    """
    needle = F.lit(term.lower())
    hit = (
        F.contains(F.lower("schema"), needle)
        | F.contains(F.lower("namespace"), needle)
        | F.contains(F.lower("service"), needle)
    )
    uses = materialize(schemas.select("schema", "namespace", "service").distinct(), "uses")
    hits = uses.where(hit).select("schema").distinct()
    return salted_join(uses, hits, ["schema"], "left_semi")
