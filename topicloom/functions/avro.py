"""Avro and Java field types as short text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat

def normalize_field_type(raw: Column) -> Column:
    """C2. ``raw`` is the type's JSON text, or the bare name of a named type.

    Unions lose null; maps, enums and other objects stay JSON text. Arrays are peeled
    one by one: there are at most as many as the text has the word "array". Bare names, which
    most types are, are taken as they stand, and only objects can be arrays.
    """
    words = F.size(F.split(raw, '"array"')) - 1

    def peel(acc: Column, _: Column) -> Column:
        is_array = F.startswith(acc["raw"], F.lit("{")) & (F.get_json_object(acc["raw"], "$.type") == "array")
        inner = F.get_json_object(acc["raw"], "$.items")
        more = ~acc["done"] & F.coalesce(is_array, F.lit(False)) & inner.isNotNull()
        return F.struct(
            (acc["levels"] + F.when(more, 1).otherwise(0)).alias("levels"),
            F.when(more, inner).otherwise(acc["raw"]).alias("raw"),
            (~more).alias("done"),
        )

    start = F.struct(F.lit(0).alias("levels"), raw.alias("raw"), F.lit(False).alias("done"))
    rounds = F.when(words > 0, F.sequence(F.lit(1), words)).otherwise(F.array().cast("array<int>"))
    return (
        F.when(F.startswith(raw, F.lit("{")), _spelled(F.aggregate(rounds, start, peel)))
        .when(F.startswith(raw, F.lit("[")), _bound(raw))
        .otherwise(raw)
    )


def _spelled(peeled: Column) -> Column:
    def spell(p: Column) -> Column:
        return F.concat(F.repeat(F.lit("array("), p["levels"]), _bound(p["raw"]), F.repeat(F.lit(")"), p["levels"]))

    return F.get(F.transform(F.array(peeled), spell), 0)


def _bound(raw: Column) -> Column:
    """``_leaf`` with its input worked out once."""
    return F.get(F.transform(F.array(raw), _leaf), 0)


def _leaf(raw: Column) -> Column:
    def union(types: Column) -> Column:
        joined = F.concat(F.lit("union("), F.array_join(types, ","), F.lit(")"))
        return F.when(F.size(types) == 1, F.get(types, 0)).otherwise(joined)

    def members() -> Column:
        return F.filter(F.from_json(raw, "array<string>"), lambda t: t != "null")

    name = F.coalesce(F.get_json_object(raw, "$.name"), F.lit("record"))
    record = F.startswith(raw, F.lit("{")) & (F.get_json_object(raw, "$.type") == "record")
    return (
        F.when(F.startswith(raw, F.lit("[")), F.get(F.transform(F.array(members()), union), 0))
        .when(record, name)
        .otherwise(raw)
    )


def normalize_java_type(raw: Column) -> Column:
    """Simple types in lower case, arrays, generic types with their arguments;
    any other type is an object."""
    simple = "|".join(cat.SIMPLE_JAVA_TYPES)
    plain = F.regexp_replace(F.regexp_replace(raw, r"\s*([<>,\[\]])\s*", "$1"), r"\s+", " ")
    bare = F.regexp_replace(plain, r"(?:\[\])+$", "")
    unbound = F.regexp_replace(bare, r"\? (?:extends|super) ", "")
    short = F.regexp_replace(unbound, r"(?<=[<,])(?:\w+\.)+\w+(?:<[^<>]*>)?", "object")
    marked = F.regexp_replace(short, rf"(?<=[<,])({simple})(?=[,>\[])", "#$1")
    others = F.regexp_replace(marked, r"(?<=[<,])(?!object\b)(?:[A-Za-z_$][\w$]*|\?)(?=[,>])", "object")
    arrays = F.regexp_replace(others, r"(?<=[<,])[A-Za-z_$][\w$]*(?:\[\])+", "array(object)")
    spelled = F.regexp_replace(arrays, r"(?:\[\])+", "")
    for name in cat.SIMPLE_JAVA_TYPES:
        spelled = F.replace(spelled, F.lit("#" + name), F.lit(name.lower()))
    return (
        F.when(bare.isin(*cat.SIMPLE_JAVA_TYPES), F.lower(bare))
        .when(F.endswith(plain, F.lit("[]")), F.lit("array(object)"))
        .when(F.rlike(bare, F.lit(r"^\w+<.+>$")), spelled)
        .otherwise(F.lit("object"))
    )
