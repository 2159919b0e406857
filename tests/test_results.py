import json
import os

import pytest
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat
from topicloom.operators import numbering, skew, topics, views
from topicloom.plans import analyze
from topicloom.plans.registered import QUERIES
from topicloom.sources import corpus as corpora
from topicloom.sources import documents
from topicloom.streaming import incremental

SAMPLE = {
    "services": {
        "service1": {
            "language": "java",
            "topics": {"topic1": {"producers": ["service1"], "consumers": ["service2"]}},
            "schemas": {"schema1": {"type": "avro", "namespace": "com.example"}},
        },
        "service2": {
            "language": "python",
            "topics": {
                "topic1": {"producers": ["service1"], "consumers": ["service2"]},
                "topic2": {"producers": ["service2"], "consumers": []},
                "idle": {"producers": [""], "consumers": []},
                "odd": 3,
            },
            "schemas": {},
        },
        "broken": "text",
        "flat": {"topics": ["x"]},
    }
}


@pytest.fixture(scope="module")
def parsed(spark):
    return documents.parse_analysis(spark.createDataFrame([(json.dumps(SAMPLE),)], "content string"))


def test_parse_documents(spark, parsed, rows):
    assert rows(parsed.services, "service", "language") == {
        ("service1", "java"), ("service2", "python"), ("flat", "unknown"),
    }
    assert rows(parsed.topics, "service", "topic") == {
        ("service1", "topic1"), ("service2", "topic1"), ("service2", "topic2"), ("service2", "idle"),
    }
    assert rows(parsed.schemas) == {("service1", "schema1", "avro", "com.example")}
    bare = documents.parse_analysis(
        spark.createDataFrame([(json.dumps(SAMPLE["services"]),)], "content string")
    )
    assert rows(bare.topics, "service", "topic") == rows(parsed.topics, "service", "topic")


def test_roles_in_result(parsed, rows):
    assert rows(topics.topic_roles_in_result(parsed.topics)) == {
        ("topic1", "service1", "producer", 1), ("topic1", "service1", "consumer", 1),
        ("topic1", "service2", "producer", 1), ("topic1", "service2", "consumer", 1),
        ("topic2", "service2", "producer", 1),
    }


def test_diagram_and_architecture(parsed, rows):
    assert rows(views.diagram_edges(parsed.topics, parsed.schemas)) == {
        ("service1", "topic_topic1", "produces"), ("topic_topic1", "service2", "consumes"),
        ("service2", "topic_topic2", "produces"), ("service1", "schema_schema1", "uses"),
    }
    got = rows(views.architecture_rows(parsed.services, parsed.topics))
    assert ("service1", "java", "topic1", "service1", "service2") in got
    assert ("service2", "python", "topic2", "service2", "None") in got
    assert ("flat", "unknown", None, None, None) in got
    stats = topics.index_stats(parsed.services, parsed.topics, parsed.schemas).first()
    assert tuple(stats) == (3, 3, 1)
    summary = topics.analysis_summary(parsed.services, parsed.topics, parsed.schemas).first()
    assert tuple(summary) == (3, 4, 1)


def _roles(spark, n=40):
    data = [("s", f"t{i % 3}", "producer" if i % 2 else "consumer", f"s/f{i}.java", i, 1) for i in range(n)]
    return spark.createDataFrame(data, "service string, topic string, role string, path string, line int, col int")


def _services(spark, *names):
    return spark.createDataFrame([(n, n, "java") for n in names], "service string, root_path string, language string")


def test_documents_are_entries_and_stay_whole(spark, tmp_path, rows):
    roles = _roles(spark)
    fields = [("a", "int")]
    schemas = spark.createDataFrame(
        [("s", f"S{i}", "avro", 'n"s', fields) for i in range(9)],
        "service string, schema string, type string, namespace string, fields array<struct<name:string,type:string>>",
    )
    docs = documents.analysis_documents(_services(spark, "s", "idle"), roles, schemas)
    parts = [json.loads(r.document) for r in docs.collect()]
    mine = [p["services"]["s"] for p in parts if "s" in p["services"]]
    assert len(mine) == 1 + 3 + 9
    places = [
        loc for p in mine for t in p["topics"].values()
        for kind in ("producer_locations", "consumer_locations") for loc in t.get(kind, {}).get("s", [])
    ]
    assert sorted(places) == sorted(f"s/f{i}.java:{i}:1" for i in range(40))
    assert {n for p in mine for n in p["schemas"]} == {f"S{i}" for i in range(9)}
    assert {s["namespace"] for p in mine for s in p["schemas"].values()} == {'n"s'}
    documents.write_analysis(docs, str(tmp_path / "out"))
    back = documents.scan_analysis(spark, str(tmp_path / "out"))
    assert rows(back.services.select("service").distinct()) == {("s",), ("idle",)}
    merged = topics.topic_roles_in_result(back.topics)
    assert rows(merged, "topic", "service", "role") == rows(roles.selectExpr("topic", "service", "role").distinct())


def test_lists_are_rows_whatever_their_length(spark):
    data = [("hot", f"v{i:03d}") for i in range(300)] + [("cold", "y"), ("cold", "x")]
    df = spark.createDataFrame(data, "k string, v string").repartition(5)
    got = numbering.numbered_lists(df, ["k"], "v").collect()
    assert sorted(map(tuple, got)) == [("cold", 0, "x"), ("cold", 1, "y")] + [("hot", i, f"v{i:03d}") for i in range(300)]


def test_measured_join_repeats_hot_keys_only(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 6}", i) for i in range(300)], "k string, v int")
    right = spark.createDataFrame([("hot", i) for i in range(20)] + [("k0", 1), ("none", 2)], "k string, w int")
    got = sorted(map(tuple, skew.measured_join(left, right, ["k"], per_salt=20).collect()))
    assert got == sorted(map(tuple, left.join(right, "k").collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.createDataFrame([(i % 7, i) for i in range(200)], "k int, v int")
    right = spark.createDataFrame([(i, i * 10) for i in range(4)], "k int, w int")
    got = sorted(map(tuple, skew.salted_join(left, right, ["k"], how).collect()), key=repr)
    assert got == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)


def test_dense_index(spark):
    df = spark.createDataFrame([(f"n{i:04d}",) for i in range(500)], "name string").repartition(7)
    got = [(r.id, r.name) for r in numbering.dense_index(df, ["name"]).collect()]
    assert sorted(got) == [(i, f"n{i:04d}") for i in range(500)]


def test_nodes_and_links(spark, tmp_path, rows):
    members = spark.createDataFrame(
        [("b", "t", "producer"), ("a", "t", "consumer"), ("ghost", "u", "producer")],
        "service string, topic string, role string",
    )
    nodes = views.viz_nodes(_services(spark, "b", "a"), members)
    assert rows(nodes, "id", "name", "type") == {
        (0, "a", "service"), (1, "b", "service"), (2, "t", "topic"), (3, "u", "topic"),
    }
    links = views.viz_links(nodes, members)
    assert rows(links) == {(1, 2, "produces"), (2, 0, "consumes")}
    schemas = spark.createDataFrame([("S",)], "schema string")
    counts = documents.write_graph(nodes, links, schemas, str(tmp_path / "graph"))
    assert rows(counts, "nodes_count", "links_count", "schemas_count") == {(4, 2, 1)}
    assert spark.read.parquet(str(tmp_path / "graph" / "links")).count() == 2


def test_neighbourhood_and_details(spark, rows):
    schemas = spark.createDataFrame(
        [("a", "S", "avro", "n"), ("b", "T", "avro", "n")],
        "service string, schema string, type string, namespace string",
    )
    members = spark.createDataFrame(
        [("a", "t", "producer"), ("b", "t", "consumer"), ("b", "u", "producer")],
        "service string, topic string, role string",
    )
    assert rows(views.schema_neighbourhood(schemas, members, "S")) == {
        ("service", "a", None, None), ("topic", None, "t", None), ("link", "a", "t", "producer"),
    }
    assert rows(views.service_details(_services(spark, "a", "z"), members, schemas)) == {
        ("a", "java", 1, 0, 1), ("z", "java", 0, 0, 0),
    }
    assert rows(views.topic_details(members)) == {("t", 1, 1), ("u", 1, 0)}
    assert rows(views.service_item_lists(members, schemas), "service", "section", "pos", "item") == {
        ("a", "produces", 0, "t"), ("a", "schemas", 0, "S"), ("b", "consumes", 0, "t"), ("b", "produces", 0, "u"),
        ("b", "schemas", 0, "T"),
    }
    clash = spark.createDataFrame([("a-b",), ("a.b",), ("c",)], "name string")
    assert rows(views.node_id_collisions(clash, "name")) == {("a_b", 2)}


def test_totals_and_filters(spark, rows):
    roles = _roles(spark, 6)
    assert rows(topics.group_by_service_topic(roles)) == {
        ("s", None, 3, 3), (None, "t0", 1, 1), (None, "t1", 1, 1), (None, "t2", 1, 1),
        ("s", "t0", 1, 1), ("s", "t1", 1, 1), ("s", "t2", 1, 1),
    }
    kept = topics.filter_topics(roles, include=["^t"], exclude=["1$"], exclude_paths=["**/f3.*"])
    assert rows(kept, "path") == {("s/f0.java",), ("s/f2.java",), ("s/f5.java",)}
    files = spark.createDataFrame([("s", "a"), ("s", "b"), ("z", "c")], "service string, path string")
    assert rows(topics.extraction_stats(files, roles)) == {("s", 2, 3, 6), ("z", 1, 0, 0)}


def test_globs():
    import re

    regex = topics.glob_to_regex("**/test/**")
    assert re.match(regex, "a/test/b/c.java") and re.match(regex, "test/x")
    assert not re.match(regex, "a/testing/b")
    assert re.match(topics.glob_to_regex("src/*.ja?a"), "src/A.java")
    assert not re.match(topics.glob_to_regex("src/*.java"), "src/a/A.java")


def test_scan_corpus(spark, tmp_path, rows):
    for name, data in {
        "a/App.java": b"line1\r\nline2\rline3\n", "a/Ünï code+1.PY": b"x", "a/image.png": b"x",
        "b/bad.java": b"\xff\xfe\x00", "b/empty.java": b"", "b/.hidden.java": b"h", "b/s.avsc": b"{}",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    got = corpora.scan_corpus(spark, str(tmp_path))
    found = {r.path: r.content for r in got.collect()}
    assert found["a/App.java"] == "line1\nline2\nline3\n"
    assert found["a/Ünï code+1.PY"] == "x"
    assert "a/image.png" not in found and "b/bad.java" not in found
    assert "b/s.avsc" in found


def test_incremental_replaces_changed_files(spark, tmp_path, rows):
    landing, store, progress = (str(tmp_path / n) for n in ("landing", "store", "progress"))

    def land(n, *pairs):
        spark.createDataFrame(list(pairs), "path string, content string").coalesce(1).write.parquet(f"{landing}/{n}")

    def run():
        stream = spark.readStream.schema("path string, content string").option("recursiveFileLookup", True).parquet(landing)
        incremental.start_extract(stream, store, progress).awaitTermination()
        return rows(incremental.current_facts(spark, store), "path", "topic")

    send = 'kafkaTemplate.send("{}")'.format
    land(1, ("a.java", send("one")), ("b.java", send("two")))
    assert run() == {("a.java", "one"), ("b.java", "two")}
    assert run() == {("a.java", "one"), ("b.java", "two")}
    land(2, ("b.java", send("three")), ("c.java", send("four")))
    land(3, ("c.java", send("four")))
    assert run() == {("a.java", "one"), ("b.java", "three"), ("c.java", "four")}
    land(4, ("a.java", "class Empty {}"))
    want = {("b.java", "three"), ("c.java", "four")}
    assert run() == want
    incremental.compact(spark, store, str(tmp_path / "compact"))
    assert rows(incremental.current_facts(spark, str(tmp_path / "compact")), "path", "topic") == want


def test_whole_analysis(spark, files, rows, tmp_path):
    corpus = files(
        ("shop/pom.xml", "<project><artifactId>shop</artifactId></project>"),
        ("shop/src/main/java/A.java", '@StreamListener("in-topic") producer.send("app.orders");'),
        ("shop/src/main/java/application.properties", "spring.cloud.stream.bindings.output1.destination=bound\nuser.url=http://u\n"),
        ("shop/src/test/java/T.java", 'producer.send("test-topic");'),
        ("shop/avro/E.avsc", '{"type": "record", "name": "E", "namespace": "n", "fields": []}'),
        ("shop/target/B.java", 'producer.send("built");'),
        ("bill/requirements.txt", "user-service\n"),
        ("bill/app.py", 'p.send("app.bills"); queue:mine'),
    )
    mine = cat.Pattern("queue", "user", "consumer", r"queue:(\w+)")
    facts = analyze.analyze(corpus, patterns=[mine]).save(str(tmp_path / "facts"))
    assert rows(facts.services, "service", "is_stub") == {("shop", False), ("bill", False), ("user-service", True)}
    assert rows(topics.topic_members(facts.roles)) == {
        ("shop", "in-topic", "consumer"), ("shop", "app.orders", "producer"), ("shop", "bound", "producer"),
        ("shop", "test-topic", "producer"), ("bill", "app.bills", "producer"), ("bill", "mine", "consumer"),
    }
    assert rows(facts.schemas, "service", "schema") == {("shop", "E")}
    assert rows(facts.relationships, "source", "target", "type") == {
        ("shop", "user", "rest-client"), ("bill", "user-service", "python-dependency"),
    }
    narrow = analyze.analyze(corpus, include_tests=False, include_topics=[r"^app\."], exclude_topics=["bills"])
    assert rows(topics.topic_members(narrow.roles)) == {("shop", "app.orders", "producer")}


def test_plugins_are_isolated(spark, files):
    plugins = analyze.Plugins()
    plugins.register("good", lambda f: f.roles.groupBy("topic").count())
    plugins.register("bad", lambda f: f.roles.select("missing"))
    corpus = files(("s/setup.py", "setup(name='s')"), ("s/a.py", 'x.send("t")'))
    done = plugins.run(analyze.analyze(corpus))
    assert [tuple(r) for r in done.extra["good"].collect()] == [("t", 1)]
    assert set(done.errors) == {"bad"}


def test_shared_folder_is_the_sessions(spark):
    from topicloom.session import materialize, shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert materialize(spark.range(3)).count() == 3
    assert os.listdir(os.path.join(shared_folder(spark), "topicloom"))


def test_written_documents_are_parsed_once(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    save("customer", [(1, 7, "AUTOMOBILE"), (2, 7, "BUILDING")], "c_custkey int, c_nationkey int, c_mktsegment string")
    save("orders", [(5, 2, "F", "1-URGENT")], "o_orderkey int, o_custkey int, o_orderstatus string, o_orderpriority string")
    save(
        "lineitem", [(5, 9, 1, 1, 10.0, "R")],
        "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity double, l_returnflag string",
    )
    got = QUERIES["s3_write_analysis"](spark, str(tmp_path))
    # the two tables of the result come from stored entries, not from two readings of the texts
    assert "from_json(MapType" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {
        ("svc-1", "java", "order-5", "svc-1", ""), ("svc-2", "java", "order-5", "", "svc-2"), ("svc-2", "java", "urgent-5", "", "svc-2"),
    }
