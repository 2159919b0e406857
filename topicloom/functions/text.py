"""Text, path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\\u0001"


def quoted(text: str) -> str:
    """A SQL string literal holding ``text`` exactly."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- match positions -------------------------------------------------------


def unmarked(content: Column) -> Column:
    """The text without the character that marks matches."""
    mark = F.lit("\u0001")
    return F.when(F.contains(content, mark), F.translate(content, "\u0001", " ")).otherwise(content)


def positions_sql(content: str, regex: str) -> str:
    """SQL for array<struct<line,col>>: 1-based start of every match, in order.

    A mark is put before each match, then the marked text is cut into lines once;
    the cost is linear in the text however many matches it has. ``content`` must
    be ``unmarked``.
    """
    marked = f"regexp_replace({content}, {quoted(regex)}, '{MARK}$0')"
    return f"""flatten(transform(split({marked}, '\\n'), (row, i) ->
        if(contains(row, '{MARK}'),
           flatten(transform(array(transform(split(row, '{MARK}', -1), s -> length(s))), sizes ->
             transform(sequence(1, size(sizes) - 1), k -> named_struct(
               'line', i + 1,
               'col', aggregate(slice(sizes, 1, k), 1, (a, n) -> a + n))))),
           cast(array() as array<struct<line: int, col: int>>))))"""


# --- paths -----------------------------------------------------------------


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_dir(path: Column) -> Column:
    """Directory of a path; the empty string for a top-level entry."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def suffix(path: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def ancestors(path: Column, depths: Column) -> Column:
    """Proper ancestor directories of a path at the given depths."""
    parts = path_parts(path)
    inner = F.filter(depths, lambda d: (d > 0) & (d < F.size(parts)))
    return F.transform(inner, lambda d: F.array_join(F.slice(parts, 1, d), "/"))


def relative_to(path: Column, root: Column) -> Column:
    return F.when(
        F.startswith(path, F.concat(root, F.lit("/"))),
        F.substring(path, F.length(root) + 2, F.length(path)),
    ).otherwise(path)


# --- names -----------------------------------------------------------------


def kebab(name: Column) -> Column:
    """CamelCase to lower-case words joined by hyphens."""
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"))


def sanitize_name(name: Column) -> Column:
    spaced = F.regexp_replace(kebab(F.coalesce(name, F.lit(""))), r"[\s_]+", "-")
    return F.regexp_replace(spaced, "[^a-z0-9-]", "")


def clean_node_id(name: Column) -> Column:
    """Diagram-safe id. ``${`` goes first so that a lone dollar sign stays."""
    opened = F.replace(name, F.lit("${"), F.lit(""))
    plain = F.translate(opened, "-. :/\\{}", "______")
    spelled = F.replace(F.replace(plain, F.lit("#"), F.lit("hash")), F.lit("@"), F.lit("at"))
    return F.when(name == "#{", "topic_hash").otherwise(spelled)


def format_topic_name(topic: Column) -> Column:
    """Shortened topic name for display."""
    bare = F.replace(F.replace(topic, F.lit("${"), F.lit("")), F.lit("}"), F.lit(""))
    last = F.substring_index(bare, ".", -1)
    words = F.split(topic, r"\.")
    after_event = F.get(words, F.array_position(words, F.lit("event")).cast("int"))
    has_event = F.array_contains(words, "event")
    return (
        F.when(topic == "#{", "hash_topic")
        .when(topic.isin("M", "topic"), topic)
        .when(
            F.contains(topic, F.lit("kafka.streams")),
            F.concat(
                F.lit("kafka.streams..."),
                F.when(last == "target-topic", "target").otherwise(last),
            ),
        )
        .when(
            F.startswith(topic, F.lit("app")),
            F.concat(
                F.lit("app..."),
                F.coalesce(
                    F.when(has_event, after_event), F.substring_index(topic, ".", -1)
                ),
            ),
        )
        .when(
            F.startswith(topic, F.lit("${config")),
            F.concat(F.lit("config.kafka..."), last),
        )
        .otherwise(topic)
    )
