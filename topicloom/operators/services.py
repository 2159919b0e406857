"""Service discovery, names and file assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.functions import text
from topicloom.operators.files import filter_test_dirs
from topicloom.operators.skew import salted_join


def _first_group(content: Column, regex: str) -> Column:
    """First capture of the regex; null when it is missing or empty."""
    return F.nullif(F.regexp_extract(content, regex, 1), F.lit(""))


def _element_text(content: Column, tag: str) -> Column:
    """Text of the first ``tag`` element in document order, comments left out.

    Elements of a default namespace are not found, as with a lookup by plain
    name. A regex, not an XML function: those fail the job on a malformed file.
    """
    plain = F.regexp_replace(content, "(?s)<!--.*?-->", "")
    found = _first_group(plain, rf"<{tag}(?:\s[^>]*)?(?:/>|>([^<]*)<)")
    return F.when(~F.contains(content, F.lit("xmlns=")), found)


def java_service_name(path: Column, content: Column) -> Column:
    """Maven artifact, Gradle root project, else the directory's name."""
    name = text.base_name(path)
    gradle = _first_group(content, r"""rootProject\.name\s*=\s*['"](.+?)['"]""")
    return F.coalesce(
        F.when(name == "pom.xml", _element_text(content, "artifactId")),
        F.when(name == "build.gradle", gradle),
        text.base_name(text.parent_dir(path)),
    )


def node_service_name(path: Column, content: Column) -> Column:
    """D3: package name without its scope, else the directory's name."""
    valid = F.try_parse_json(content)
    name = F.when(valid.isNotNull(), F.get_json_object(content, "$.name"))
    return F.coalesce(
        F.substring_index(F.nullif(name, F.lit("")), "/", -1),
        text.base_name(text.parent_dir(path)),
    )


def python_service_name(path: Column, content: Column) -> Column:
    """Name in setup.py or pyproject.toml, the directory for requirements.txt.
    Null when a setup.py or pyproject.toml gives no name."""
    name = text.base_name(path)
    setup = _first_group(content, r"""(?s)setup\s*\([^)]*name\s*=\s*['"]([^'"]+)['"]""")
    project = _first_group(content, r"""(?s)\[project\][^\[]*name\s*=\s*['"]([^'"]+)['"]""")
    found = (
        F.when(name == "setup.py", setup)
        .when(name == "pyproject.toml", project)
        .otherwise(text.base_name(text.parent_dir(path)))
    )
    return F.when(found.isNotNull(), text.sanitize_name(found))


def csharp_service_name(path: Column, content: Column) -> Column:
    """Assembly, root namespace or package id, else the file's stem."""
    tags = ("AssemblyName", "RootNamespace", "PackageId")
    stem = F.regexp_replace(text.base_name(path), r"(?<=.)\.[^.]+$", "")
    return text.sanitize_name(
        F.coalesce(*[_element_text(content, t) for t in tags], stem)
    )


def build_files(files: DataFrame) -> DataFrame:
    """(path, content, dir, language, priority) of build files, root excluded."""
    path = F.col("path")
    name = text.base_name(path)
    order = F.lit(None).cast("int")
    language = F.lit(None).cast("string")
    for i, (lang, pattern) in reversed(list(enumerate(cat.BUILD_FILES))):
        # a project file has a name of its own before its suffix
        hit = F.endswith(name, F.lit(pattern)) if pattern.startswith(".") else name == pattern
        order = F.when(hit, F.lit(i)).otherwise(order)
        language = F.when(hit, F.lit(lang)).otherwise(language)
    return files.select(
        "path",
        "content",
        text.parent_dir(path).alias("dir"),
        language.alias("language"),
        order.alias("priority"),
    ).where(
        F.col("priority").isNotNull()
        & ~F.col("dir").isin("", *[d for d in cat.TEST_DIRS if "/" not in d])
    )


def service_name(path: Column, content: Column, language: Column) -> Column:
    return (
        F.when(language == "java", java_service_name(path, content))
        .when(language == "javascript", node_service_name(path, content))
        .when(language == "python", python_service_name(path, content))
        .when(language == "csharp", csharp_service_name(path, content))
    )


def detect_services(files: DataFrame) -> DataFrame:
    """One service per directory with a build file that yields a name.

    Columns service, root_path, language, build_file, is_stub. The choice among
    several build files is an aggregate with a partial step, not a window.
    """
    named = build_files(files).select(
        "dir",
        "priority",
        "language",
        F.col("path").alias("build_file"),
        service_name(F.col("path"), F.col("content"), F.col("language")).alias("service"),
    ).where(F.col("service") != "")
    best = F.min_by(
        F.struct("service", "language", "build_file"), F.struct("priority", "build_file")
    )
    return (
        named.groupBy(F.col("dir").alias("root_path"))
        .agg(best.alias("best"))
        .select(
            "best.service",
            "root_path",
            "best.language",
            "best.build_file",
            F.lit(False).alias("is_stub"),
        )
    )


def upsert_services(services: DataFrame, order: str = "root_path") -> DataFrame:
    """One row per name, the last registration by ``order`` wins."""
    others = [c for c in services.columns if c != "service"]
    return (
        services.groupBy("service")
        .agg(F.max_by(F.struct(*others), F.col(order)).alias("last"))
        .select("service", "last.*")
    )


def assign_files(rows: DataFrame, services: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows with a ``path`` gain service, root_path and language.

    Each row meets the services by equality with one of its path's ancestor
    directories; nested roots both match. Only ancestors as deep as some service
    root are tried, so a row is repeated once per such depth. Assign narrow fact
    rows, not texts. ``tasks`` as in ``salted_join``.
    """
    roots = services.where(~F.col("is_stub")).select("root_path", "service", "language")
    depth = F.size(text.path_parts(F.col("root_path")))
    depths = roots.agg(F.collect_set(depth)).scalar()
    tried = text.ancestors(F.col("path"), F.col("_depths"))
    spread = rows.withColumn("_depths", depths).withColumn("root_path", F.explode(tried))
    return salted_join(spread.drop("_depths"), roots, ["root_path"], spread=["path"], tasks=tasks)


def source_files(files: DataFrame, services: DataFrame) -> DataFrame:
    """(service, path): files of the service's language outside its tests."""
    by_language = F.lit(False)
    for language, suffixes in cat.LANGUAGE_SUFFIXES.items():
        by_language = by_language | (
            (F.col("language") == language) & text.suffix(F.col("path")).isin(*suffixes)
        )
    owned = assign_files(files.select("path"), services).where(by_language)
    return filter_test_dirs(owned).select("service", "path")


def camel_to_service(name: Column) -> Column:
    """An injected class name as a service name."""
    return text.kebab(name)
