"""Which files are looked at, and by which analyser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.functions import text


def is_source_path(path: Column) -> Column:
    """A known source suffix, and no hidden or skipped part on the way.

    ``path`` is relative to the corpus root, so where the corpus is stored does
    not decide what is kept.
    """
    skipped = F.array(*[F.lit(d) for d in cat.SKIPPED_DIRS])
    parts = text.path_parts(path)
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    return (
        text.suffix(path).isin(*cat.SOURCE_SUFFIXES)
        & ~hidden
        & ~F.arrays_overlap(parts, skipped)
    )


def filter_source_files(files: DataFrame) -> DataFrame:
    return files.where(is_source_path(F.col("path")))


def is_test_path(relative: Column) -> Column:
    """Below a test directory of the service. The test is a plain prefix test, so
    a sibling such as ``testing/`` counts as well."""
    out = F.lit(False)
    for d in cat.TEST_DIRS:
        out = out | F.startswith(relative, F.lit(d))
    return out


def filter_test_dirs(service_files: DataFrame, include_tests: bool = False) -> DataFrame:
    """Drop files in test directories, by path relative to the service root."""
    if include_tests:
        return service_files
    return service_files.where(
        ~is_test_path(text.relative_to(F.col("path"), F.col("root_path")))
    )


def filter_messaging_test_paths(files: DataFrame) -> DataFrame:
    """Drop test sources, except kept test data."""
    path = F.col("path")
    tests = F.contains(path, F.lit("src/test")) | F.contains(path, F.lit("test/"))
    return files.where(~tests | F.contains(path, F.lit("tests/test_data")))


def any_in(content: Column, literals) -> Column:
    """Whether any of the literals occurs; substring tests, no regex."""
    return reduce(Column.__or__, [F.contains(content, F.lit(t)) for t in literals])


def is_ignored(content: Column) -> Column:
    return any_in(content, cat.SPRING_IGNORE)


def ignore_by_content(files: DataFrame) -> DataFrame:
    return files.where(~is_ignored(F.col("content")))


def is_rest(content: Column) -> Column:
    mapped = F.contains(content, F.lit("Mapping")) & F.rlike(content, F.lit(cat.REST_MAPPING))
    return any_in(content, cat.REST_MARKERS) | mapped


def is_java(path: Column) -> Column:
    """A ``.java`` suffix in any case, with a name before it."""
    return F.rlike(path, F.lit(r"(?i)[^/]\.java\z"))


def is_spring(path: Column, content: Column) -> Column:
    """A Java file with an application class, a messaging form or a REST form.

    A form's regex is tried only where its literal occurs.
    """
    forms = [
        any_in(content, p.needles) & F.rlike(content, F.lit(p.regex))
        for p in cat.SPRING_PRODUCERS + cat.SPRING_CONSUMERS
    ]
    found = reduce(Column.__or__, forms, F.contains(content, F.lit(cat.SPRING_APPLICATION)))
    return is_java(path) & (found | is_rest(content))


def applicable_files(files: DataFrame) -> DataFrame:
    """(path, analyzer): which analyser handles which file."""
    path, content = F.col("path"), F.col("content")
    analyzers = F.array_compact(
        F.array(
            F.when(is_java(path), "java"),
            F.lit("generic"),
            F.when(is_spring(path, content), "spring"),
        )
    )
    return files.select("path", F.explode(analyzers).alias("analyzer"))


def rest_endpoints(files: DataFrame) -> DataFrame:
    """(path, method, endpoint) of mappings; a REST file without any has one row
    with nulls, so that every exposing file is listed."""
    content = F.col("content")
    found = F.zip_with(
        F.regexp_extract_all(content, F.lit(cat.REST_MAPPING), 1),
        F.regexp_extract_all(content, F.lit(cat.REST_MAPPING), 2),
        lambda m, e: F.struct(F.upper(m).alias("method"), e.alias("endpoint")),
    )
    return (
        files.where(is_java(F.col("path")) & is_rest(content))
        .select("path", F.explode_outer(found).alias("found"))
        .select("path", "found.method", "found.endpoint")
    )
