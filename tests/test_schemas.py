import json

import pytest
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.functions.avro import normalize_field_type, normalize_java_type
from topicloom.operators import schemas as c

# a reading of a weather station
READING = {
    "namespace": "weather.stations",
    "type": "record",
    "name": "Reading",
    "fields": [
        {"name": "celsius", "type": "double"},
        {"name": "remark", "type": ["string", "null"]},
        {"name": "gusts", "type": {"items": "float", "type": "array"}},
        {"name": "sensor", "type": {"name": "Sensor", "type": "record", "fields": [{"name": "serial", "type": "int"}]}},
        {"name": "alarm", "type": ["null", "boolean", "string"]},
    ],
}


def _fields(schemas):
    return {s.schema: [tuple(f) for f in s.fields] for s in schemas.collect()}


def test_avsc(files):
    good = json.dumps(READING)
    corpus = files(
        ("wx/Reading.avsc", good),
        ("wx/cut.avsc", good[: len(good) // 2]),
        ("wx/several.avsc", f"[{good}]"),
        ("wx/Sky.avsc", '{"type": "enum", "name": "Sky", "symbols": ["CLEAR", "CLOUDY"]}'),
        ("wx/Empty.avsc", '{"name": "Empty", "type": "record"}'),
        ("wx/Reading.txt", good),
    )
    found = c.avro_schemas(corpus)
    assert _fields(found) == {
        "Empty": [],
        "Reading": [
            ("celsius", "double"), ("remark", "string"), ("gusts", "array(float)"), ("sensor", "Sensor"),
            ("alarm", "union(boolean,string)"),
        ],
    }
    assert {(r.schema, r.namespace) for r in found.collect()} == {("Reading", "weather.stations"), ("Empty", "")}


def test_a_document_is_parsed_once(files):
    """Its record is not parsed again for the filter on its type (one parser of records in the plan)."""
    plan = c.avro_schemas(files(("wx/Reading.avsc", json.dumps(READING))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(") == 1


def _nested(depth):
    kind = "string"
    for _ in range(depth):
        kind = {"type": "array", "items": kind}
    return kind


@pytest.mark.parametrize(
    "kind, want",
    [
        ("string", "string"),
        (["null", "string", "int"], "union(string,int)"),
        (["null", "string"], "string"),
        ({"type": "array", "items": ["null", "int", "Foo"]}, "array(union(int,Foo))"),
        ({"type": "record", "fields": []}, "record"),
        (_nested(16), "array(" * 16 + "string" + ")" * 16),
        (_nested(60), "array(" * 60 + "string" + ")" * 60),
        ({"type": "map", "values": "int"}, '{"type":"map","values":"int"}'),
    ],
)
def test_field_types(spark, kind, want):
    raw = kind if isinstance(kind, str) else json.dumps(kind, separators=(",", ":"))
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(normalize_field_type(F.col("v")).alias("r")).first().r == want


@pytest.mark.parametrize(
    "raw, want",
    [("array", "array"), ('["null",{"type":"array","items":"int"}]', '{"type":"array","items":"int"}'), (None, None), ("", "")],
)
def test_types_that_are_taken_as_they_stand(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "v string")
    assert df.select(normalize_field_type(F.col("v")).alias("r")).first().r == want


@pytest.mark.parametrize(
    "kind, want",
    [
        ("int", "int"), ("String", "string"), ("String[]", "string"), ("Foo[]", "array(object)"),
        ("Foo", "object"), ("byte", "object"), ("List<String>", "List<string>"),
        ("Map< String , Foo >", "Map<string,object>"), ("List<List<String>>", "List<List<string>>"),
        ("java.util.List<String>", "object"), ("List<? extends String>", "List<string>"),
        ("List<java.lang.String>", "List<object>"), ("Set<?>", "Set<object>"),
    ],
)
def test_java_types(spark, kind, want):
    df = spark.createDataFrame([(kind,)], "v string")
    assert df.select(normalize_java_type(F.col("v")).alias("r")).first().r == want


STATION = """package weather.stations;

// made by a tool: class Ghost { int none; }
@org.apache.avro.specific.AvroGenerated
public final class Station extends Place {
    private double latitude, longitude;
    static final String NOTE = "not a } brace";
    protected java.util.List<String> names;
    Set<Reading> readings = new HashSet<>();
    private Tower[] towers;
    /* private int lost; */
    static { if (NOTE == null) { throw new Error("{"); } }
    Station(double latitude) { this.latitude = latitude; }
    class Part { int inner; class Sub { int innermost; } }
    @Deprecated boolean closed;
    <DEEP>
    long opened = 0L;
}

class Annex { private int rooms; }
"""


def test_generated_classes(files):
    deep = "void nest() " + "{ if (x) " * 60 + "{ int y; }" + " }" * 60
    found = c.generated_classes(
        files(
            ("wx/Station.java", STATION.replace("<DEEP>", deep)),
            ("wx/Plain.java", "class Plain { int x; }"),
            ("wx/station.py", STATION),
        )
    )
    assert _fields(found) == {
        "Station": [
            ("latitude", "double"), ("longitude", "double"), ("NOTE", "string"), ("names", "object"),
            ("readings", "Set<object>"), ("towers", "array(object)"), ("closed", "boolean"), ("opened", "long"),
        ]
    }
    assert found.first().namespace == "weather.stations"


def test_registry(spark, files, rows):
    code = """
        var gusts = schemaRegistry.getSchema('wx-gusts');
        String fixed = "https://registry.wx:443/subjects/wx-rain/versions/4";
        schemaRegistry.registerSchema("wx-snow");
        schemaRegistry.getSchema("/local/path");
    """
    corpus = files(("wx/Client.java", code), ("wx/client.md", code))
    refs = c.registry_refs(corpus)
    assert {(r.subject, r.version) for r in refs.collect()} == {("wx-gusts", "latest"), ("wx-snow", "latest"), ("wx-rain", "4")}
    assert {r.url for r in refs.collect() if r.subject != "wx-rain"} == {
        f"{cat.REGISTRY_BASE}/subjects/{s}/versions/latest" for s in ("wx-gusts", "wx-snow")
    }

    def record(name):
        return json.dumps({"type": "record", "name": name, "fields": []})

    snapshot = spark.createDataFrame(
        [("wx-gusts", 9, record("Gusts9")), ("wx-gusts", 11, record("Gusts11")), ("wx-rain", 4, record("Rain4")),
         ("wx-rain", 5, record("Rain5")), ("wx-snow", 2, '["null"]')],
        "subject string, version int, schema string",
    )
    assert rows(c.registry_schemas(refs, snapshot), "schema") == {("Gusts11",), ("Rain4",)}


def _owned(spark, *entries):
    return spark.createDataFrame(
        [(sv, n, "avro", ns, p, []) for sv, n, ns, p in entries],
        f"service string, schema string, type string, namespace string, path string, fields {c.FIELDS}",
    )


def test_merge_and_search(spark, rows):
    avsc = _owned(spark, ("s", "A", "avsc", "1"), ("s", "A", "later", "2"), ("s", "B", "avsc", "1"), ("t", "A", "avsc", "1"))
    classes = _owned(spark, ("s", "B", "class", "1"))
    registry = _owned(spark, ("s", "B", "reg", "0"))
    merged = c.merge_schemas(avsc, classes, registry)
    assert rows(merged, "service", "schema", "namespace") == {("s", "A", "later"), ("s", "B", "reg"), ("t", "A", "avsc")}
    assert rows(c.search_schemas(merged, "T"), "schema", "service") == {("A", "s"), ("A", "t")}
    assert rows(c.search_schemas(merged, "REG"), "schema") == {("B",)}


def test_search_reads_its_input_once(spark, rows):
    """The schemas are worked out once, for the uses; hits and answer read these."""
    owned = _owned(spark, ("s", "A", "n", "1"), ("s", "A", "n", "2"), ("t", "A", "m", "1"), ("t", "B", "m", "1"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = c.search_schemas(owned.mapInArrow(count, owned.schema), "n")
    assert rows(found, "schema", "namespace", "service") == {("A", "n", "s"), ("A", "m", "t")}
    assert seen.value == 4


def test_diff(spark, rows):
    def fields(*entries):
        return spark.createDataFrame([("S", *e) for e in entries], "schema string, field string, field_type string")

    got = c.schema_diff(fields(("a", "int"), ("b", "int"), ("c", "int")), fields(("a", "int"), ("b", "long"), ("d", "int")))
    assert rows(got, "field", "change", "old_type", "new_type") == {
        ("b", "retyped", "int", "long"), ("c", "removed", "int", None), ("d", "added", None, "int"),
    }
