"""Texts to facts (X1-X13): every operator here is map-only over the texts.

All patterns of a text are evaluated in one projection and leave as narrow fact
rows; the text itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.functions import text, yaml
from topicloom.functions.text import positions_sql, quoted
from topicloom.operators import files as file_ops

PLACE = "struct<line: int, col: int>"
FACT = (
    "struct<analyzer: string, pattern: string, role: string, token: string, "
    "topic: string, line: int, col: int>"
)
VARS = "array<struct<name: string, value: string>>"


# --- captures --------------------------------------------------------------


def _guarded(content: str, needles: Iterable[str], found: str, kind: str) -> str:
    """``found`` where a needle occurs, an empty array where none does."""
    tests = [f"contains({content}, {quoted(n)})" for n in needles]
    if not tests:
        return found
    return f"if({' or '.join(tests)}, {found}, cast(array() as {kind}))"


def _captures(regex: str, group: int = 1, content: str = "content") -> str:
    return f"regexp_extract_all({content}, {quoted(regex)}, {group})"


def _pairs(regex: str, needles: Iterable[str], content: str = "content") -> str:
    """array<struct<name,value>> from a regex with two groups."""
    zipped = f"""zip_with({_captures(regex, 1, content)}, {_captures(regex, 2, content)},
        (n, v) -> named_struct('name', n, 'value', v))"""
    return _guarded(content, needles, zipped, VARS)


def _placed(regex: str, group: int, locate: bool) -> str:
    """array<struct<token,line,col>> of one regex."""
    caps = _captures(regex, group)
    if not locate:
        return (
            f"transform({caps}, c -> named_struct('token', c, "
            "'line', cast(null as int), 'col', cast(null as int)))"
        )
    zipped = f"""zip_with(found, {positions_sql('content', regex)},
        (c, p) -> named_struct('token', c, 'line', p.line, 'col', p.col))"""
    none = "cast(array() as array<struct<token: string, line: int, col: int>>)"
    return f"flatten(transform(array({caps}), found -> if(size(found) > 0, {zipped}, {none})))"


def _items(token: str) -> str:
    """Quoted items of a list capture, else its comma-separated words."""
    return f"""if({token} rlike '["\\']',
        regexp_extract_all({token}, '["\\']([^"\\']+)["\\']', 1),
        filter(transform(split({token}, ','), w -> regexp_replace(w, '^\\\\s+|\\\\s+$', '')), w -> w != ''))"""


def split_topic_list(token: Column) -> Column:
    """X5 as a column function."""
    quoted_items = F.regexp_extract_all(token, F.lit("[\"']([^\"']+)[\"']"), 1)
    words = F.filter(
        F.transform(F.split(token, ","), lambda w: F.regexp_replace(w, r"^\s+|\s+$", "")),
        lambda w: w != "",
    )
    return F.when(F.rlike(token, F.lit("[\"']")), quoted_items).otherwise(words)


# --- names to topics -------------------------------------------------------


def _lookup(variables: str, token: str) -> str:
    """Value of the last declaration of ``token``; null when there is none."""
    return f"try_element_at(filter({variables}, v -> v.name = {token}), -1).value"


def _java_topic(token: str) -> str:
    bare = f"trim(BOTH ' \"\\'' FROM {token})"
    return f"""transform(array({bare}), t -> coalesce({_lookup('java_vars', 't')},
        case when startswith(t, '${{') and endswith(t, '}}') then t
             when startswith(t, 'kafka.') or contains(t, '.kafka.') then concat('${{', t, '}}')
             else t end))[0]"""


def normalize_topic(token: Column) -> Column:
    """X8 as a column function: strip quotes, wrap configuration keys."""
    bare = F.regexp_replace(token, "^[ \"']+|[ \"']+$", "")
    keyed = F.startswith(bare, F.lit("kafka.")) | F.contains(bare, F.lit(".kafka."))
    wrapped = F.startswith(bare, F.lit("${")) & F.endswith(bare, F.lit("}"))
    return F.when(wrapped, bare).when(keyed, F.concat(F.lit("${"), bare, F.lit("}"))).otherwise(bare)


def _topic(analyzer: str, token: str) -> str:
    if analyzer == "java":
        return _java_topic(token)
    if analyzer == "generic":
        return f"coalesce({_lookup('generic_vars', token)}, {token})"
    return token


# --- facts -----------------------------------------------------------------


def _fact(analyzer: str, pattern: str, role: str, token: str, topic: str, at: str) -> str:
    return f"""named_struct('analyzer', {quoted(analyzer)}, 'pattern', {quoted(pattern)},
        'role', {role}, 'token', {token}, 'topic', {topic}, 'line', {at}.line, 'col', {at}.col)"""


def _role(role: str | None) -> str:
    return quoted(role) if role else "cast(null as string)"


def _applies(p: cat.Pattern) -> str | None:
    if p.analyzer == "spring":
        return "java_file and not spring_ignored"
    if p.suffix == ".java":
        return "java_file"
    if p.suffix:
        return f"endswith(lower(path), {quoted(p.suffix)})"
    return None


def _pattern_facts(p: cat.Pattern, locate: bool) -> str:
    """The facts of one pattern, for a text in which a needle of its occurs."""
    placed = _placed(p.regex, p.group, locate)
    role = _role(p.role)
    if p.topic is not None:
        each = _fact(p.analyzer, p.name, role, "m.token", quoted(p.topic), "m")
        facts = f"transform({placed}, m -> {each})"
    elif p.listed:
        each = _fact(p.analyzer, p.name, role, "t", _topic(p.analyzer, "t"), "m")
        facts = f"flatten(transform({placed}, m -> transform({_items('m.token')}, t -> {each})))"
    else:
        each = _fact(p.analyzer, p.name, role, "m.token", _topic(p.analyzer, "m.token"), "m")
        facts = f"transform({placed}, m -> {each})"
    applies = _applies(p)
    return f"if({applies}, {facts}, cast(array() as array<{FACT}>))" if applies else facts


def _catalogue_facts(patterns: Iterable[cat.Pattern], locate: bool) -> list[str]:
    """The facts of all patterns; those with the same needles share one test for them."""
    by_needles: dict[tuple[str, ...], list[str]] = {}
    for p in patterns:
        by_needles.setdefault(tuple(p.needles), []).append(_pattern_facts(p, locate))
    return [
        _guarded("content", needles, f"concat({', '.join(facts)})", f"array<{FACT}>")
        for needles, facts in by_needles.items()
    ]


def _config_facts(locate: bool) -> str:
    """``@Value`` keys; the 200 characters around decide the role.

    The text is cut before every key, so each piece after the first starts with
    one and is at least a character long: 200 pieces always hold the context.
    """
    keys, whole = _captures(cat.VALUE_KEY, 1), _captures(cat.VALUE_KEY, 0)
    places = (
        positions_sql("content", cat.VALUE_KEY)
        if locate
        else f"transform({whole}, c -> cast(null as {PLACE}))"
    )
    near = cat.CONTEXT_CHARS
    marked = f"regexp_replace(content, {quoted(cat.VALUE_KEY)}, '{text.MARK}$0')"
    cut = f"split({marked}, '{text.MARK}', -1)"
    before = f"right(array_join(slice(pieces, greatest(1, i + 2 - {near}), least(i + 1, {near})), ''), {near})"
    after = f"left(array_join(slice(pieces, i + 2, {near} + 1), ''), length(z.`1`) + {near})"
    words = " or ".join(f"contains(near, {quoted(w)})" for w in cat.PRODUCER_WORDS)
    role = f"transform(array(lower(concat({before}, {after}))), near -> if({words}, 'producer', 'consumer'))[0]"
    each = _fact("java", "config_key", role, "z.`0`", "concat('${', z.`0`, '}')", "z.`2`")
    facts = f"""filter(flatten(transform(array({cut}), pieces ->
        transform(arrays_zip({keys}, {whole}, {places}), (z, i) -> {each}))),
        f -> contains(lower(f.token), 'kafka') and contains(lower(f.token), 'topic'))"""
    guarded = _guarded("content", ["@Value"], facts, f"array<{FACT}>")
    return f"if(java_file, {guarded}, cast(array() as array<{FACT}>))"


def _constant_facts(locate: bool) -> list[str]:
    """X11: constants passed to a send or subscribe call. The identifiers in the
    call are looked up; no regex is built per constant."""
    known = "exists(java_vars, v -> v.name = {0})"
    send = _placed(cat.CONST_SEND, 1, locate)
    sent = _fact("java", "const_send", "'producer'", "m.token", _java_topic("m.token"), "m")
    sends = f"transform(filter({send}, m -> {known.format('m.token')}), m -> {sent})"
    subscribe = _placed(cat.CONST_SUBSCRIBE, 1, locate)
    heard = _fact("java", "const_subscribe", "'consumer'", "t", _java_topic("t"), "m")
    names = "array_distinct(regexp_extract_all(m.token, '(?U)\\\\w+', 0))"
    subscribes = f"""flatten(transform({subscribe}, m -> transform(
        filter({names}, t -> {known.format('t')}), t -> {heard})))"""
    out = []
    for facts, needles in (
        (sends, (".send", ".publish")),
        (subscribes, ("consumer.subscribe",)),
    ):
        guarded = _guarded("content", needles, facts, f"array<{FACT}>")
        out.append(f"if(size(java_vars) > 0, {guarded}, cast(array() as array<{FACT}>))")
    return out


def _second_last(name: str) -> str:
    return f"""if(contains({name}, '.'),
        transform(array(split({name}, '[.]')), p -> p[size(p) - 2])[0], {name})"""


def _declared_vars() -> str:
    """Names a file declares as topics, as (name, value) pairs."""
    parts = [
        _pairs(cat.GENERIC_CONSTANT, ["String"]),
        _pairs(cat.VALUE_FIELD, ["@Value"]),
    ]
    for regex, needle in (
        (cat.BINDING_DESTINATION, "spring.cloud.stream.bindings."),
        (cat.TOPIC_CONFIG, "@TopicConfig"),
    ):
        same = f"""transform({_captures(regex)}, n -> transform(array({_second_last('n')}),
            s -> named_struct('name', s, 'value', s))[0])"""
        parts.append(_guarded("content", [needle], same, VARS))
    return f"concat({', '.join(parts)})"


def prepared(files: DataFrame) -> DataFrame:
    """Texts with what the fact expressions need besides: flags and declared names."""
    java_file = file_ops.is_java(F.col("path"))
    return files.select(
        *[c for c in files.columns if c != "content"],
        text.unmarked(F.col("content")).alias("content"),
        java_file.alias("java_file"),
        (java_file & file_ops.is_ignored(F.col("content"))).alias("spring_ignored"),
        F.when(java_file, F.expr(_pairs(cat.JAVA_CONSTANT, ["String"])))
        .otherwise(F.expr(f"cast(array() as {VARS})"))
        .alias("java_vars"),
        F.expr(_declared_vars()).alias("generic_vars"),
    )


def _all_facts(patterns: Iterable[cat.Pattern], locate: bool, derived: bool) -> str:
    facts = [f"cast(array() as array<{FACT}>)", *_catalogue_facts(patterns, locate)]
    if derived:
        facts += [_config_facts(locate), *_constant_facts(locate)]
    return f"filter(flatten(array({', '.join(facts)})), f -> f.topic != '')"


def topic_facts(
    files: DataFrame,
    patterns: Iterable[cat.Pattern] = cat.CATALOGUE,
    locate: bool = True,
    derived: bool = True,
    keep_files: bool = False,
) -> DataFrame:
    """(path, analyzer, pattern, role, token, topic, line, col).

    ``patterns`` may hold user patterns next to the built-in ones. ``derived``
    adds configuration keys (X9) and constants in calls (X11). ``locate=False``
    leaves line and column null and saves their work where only roles matter.
    ``keep_files`` gives a file without any match one row of nulls.
    """
    every = _all_facts(patterns, locate, derived)
    generator = "inline_outer" if keep_files else "inline"
    return prepared(files).select("path", F.expr(f"{generator}({every})"))


def fact_lists(
    files: DataFrame, patterns: Iterable[cat.Pattern] = cat.CATALOGUE, locate: bool = True
) -> DataFrame:
    """(path, facts): the facts of ``topic_facts`` as one row per text, with an empty
    array for a text without any, or for no text."""
    every = _all_facts(patterns, locate, True)
    return prepared(files).select("path", F.expr(f"coalesce({every}, cast(array() as array<{FACT}>))").alias("facts"))


def role_facts(
    files: DataFrame, patterns: Iterable[cat.Pattern] = cat.CATALOGUE, locate: bool = True
) -> DataFrame:
    """(path, role, topic, line, col): the facts that carry a role, merged over
    patterns and analysers within the row of their text, before any shuffle."""
    return prepared(files).select("path", F.expr(f"inline({role_array(patterns, locate)})"))


def role_array(patterns: Iterable[cat.Pattern], locate: bool = True) -> str:
    """SQL for array<struct<role,topic,line,col>>, over ``prepared`` texts."""
    every = _all_facts(patterns, locate, True)
    return f"""array_distinct(transform(filter({every}, f -> f.role is not null),
        f -> named_struct('role', f.role, 'topic', f.topic, 'line', f.line, 'col', f.col)))"""


def match_patterns(
    files: DataFrame, patterns: Iterable[cat.Pattern], locate: bool = True
) -> DataFrame:
    """X1 for any pattern list (U1): the raw captures of each pattern."""
    return topic_facts(files, patterns, locate, derived=False)


def locate_matches(files: DataFrame, regex: str, group: int = 0) -> DataFrame:
    """(path, match, line, col) of every match of one regex."""
    found = F.expr(_placed(regex, group, True))
    texts = files.select("path", text.unmarked(F.col("content")).alias("content"))
    return texts.select("path", F.inline(found)).withColumnRenamed("token", "match")


def extract_constants(files: DataFrame) -> DataFrame:
    """(path, name, value); the last declaration in a file wins."""
    pairs = _pairs(cat.JAVA_CONSTANT, ["String"])
    numbered = f"""transform({pairs},
        (v, i) -> named_struct('name', v.name, 'value', v.value, 'pos', i))"""
    return (
        files.where(file_ops.is_java(F.col("path")))
        .select("path", F.expr(f"inline({numbered})"))
        .groupBy("path", "name")
        .agg(F.max_by("value", "pos").alias("value"))
    )


def resolve_constants(uses: DataFrame, constants: DataFrame) -> DataFrame:
    """X7 as a join: token of the same file's constant, else the token itself."""
    named = constants.select("path", F.col("name").alias("token"), "value")
    return (
        uses.join(named, ["path", "token"], "left")
        .withColumn("topic", F.coalesce("value", "token"))
        .drop("value")
    )


def declared_topics(files: DataFrame) -> DataFrame:
    """(path, name, topic) of declared topics; they carry no role."""
    return files.select("path", F.expr(f"inline({_declared_vars()})")).withColumnRenamed(
        "value", "topic"
    )


# --- configuration files next to sources -----------------------------------


def yaml_settings(files: DataFrame, wanted: str | None = None) -> DataFrame:
    """(path, name, value) of every setting in YAML configuration, keys dotted; of those
    whose name matches ``wanted``, if given."""
    kept = files.where(text.base_name(F.col("path")).isin(*cat.YAML_CONFIGS))
    return kept.select("path", F.inline(yaml.settings(F.col("content"), wanted)))


def config_pairs(files: DataFrame, regex: str, needle: str) -> DataFrame:
    """(dir, path, name, value) from application configuration files: dotted lines as they
    stand, and in YAML nested keys that end like ``needle`` where their word occurs."""
    path, content = F.col("path"), F.col("content")
    words = cat.NESTED_KEYS[needle]
    nested = text.base_name(path).isin(*cat.YAML_CONFIGS) & reduce(or_, [F.contains(content, F.lit(w)) for w in words])
    dotted = F.when(nested, yaml.as_properties(content, rf"(?:^|\.)(?:{'|'.join(words)})$"))
    configs = files.where(text.base_name(path).isin(*cat.SPRING_CONFIGS)).withColumn(
        "content", F.explode(F.array_compact(F.array(content, dotted)))
    )
    return configs.select(
        text.parent_dir(path).alias("dir"),
        "path",
        F.expr(f"inline({_pairs(regex, [needle])})"),
    )


def directories(paths: DataFrame) -> DataFrame:
    return paths.select(text.parent_dir(F.col("path")).alias("dir")).distinct()


def spring_dirs(files: DataFrame) -> DataFrame:
    """Directories that hold a Spring source file."""
    return directories(files.where(file_ops.is_spring(F.col("path"), F.col("content"))))


def stream_bindings(files: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """(path, binding, topic, role) of bindings configured next to a Spring
    source. The binding's name tells the role: input or output."""
    found = config_pairs(files, cat.STREAM_BINDING, "spring.cloud.stream.bindings.")
    name = F.lower("binding")
    return (
        found.join(spring_dirs(files) if dirs is None else dirs, "dir", "left_semi")
        .select(
            "path",
            F.col("name").alias("binding"),
            F.regexp_replace("value", "^[\"']+|[\"']+$", "").alias("topic"),
        )
        .withColumn(
            "role",
            F.when(F.contains(name, F.lit("input")), "consumer").when(
                F.contains(name, F.lit("output")), "producer"
            ),
        )
    )
