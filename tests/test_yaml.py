"""Nested configuration as people write it."""

import pytest

from topicloom.functions import yaml
from topicloom.operators import extraction
from pyspark.sql import functions as F

CASES = [
    ("", []),
    ("a: 1\nb:\n  c: x\n  d:\n    e: y\nf: z\n", [("a", "1"), ("b.c", "x"), ("b.d.e", "y"), ("f", "z")]),
    ("a:\n- x\n- y\nb: 2", [("a[0]", "x"), ("a[1]", "y"), ("b", "2")]),
    ("a:\n  - n: x\n    m: 1\n  - n: y\n    k:\n    - p\n    - q\nb: 2", [
        ("a[0].n", "x"), ("a[0].m", "1"), ("a[1].n", "y"), ("a[1].k[0]", "p"), ("a[1].k[1]", "q"), ("b", "2")]),
    ("'a.b': \"c # d\" # e\n\"x y\":\n  z: 'it''s'\n", [("a.b", "c # d"), ("x y.z", "it's")]),
    ("u: http://h:80/p#q\nv: a b  # c\nw: # nothing\n  x: 1", [("u", "http://h:80/p#q"), ("v", "a b"), ("w.x", "1")]),
    ("a: |\n  b: no\n\n  c: no\nd: >-\n  e: no\nf: 1", [("f", "1")]),
    ("a:\n  b: 1\n---\nc: 2\n...\n  d: 3", [("a.b", "1"), ("c", "2"), ("d", "3")]),
    ("a.b.c:\r\n  d: 1\r\n  # e: 2\r\n\r\n  f: 3", [("a.b.c.d", "1"), ("a.b.c.f", "3")]),
    ("a:\n    b:\n        c: 1\n    d: 2\n  e: 3", [("a.b.c", "1"), ("a.d", "2"), ("a.e", "3")]),
    ("a: !!str 5\nb: &x y\nc: *x\n- z", [("a", "5"), ("b", "y"), ("c", "*x"), ("c[0]", "z")]),
    ("a: &b\n  c: 1", [("a.c", "1")]),
    ("-x: 1\n- -5\nnot a key\nk:v", [("-x", "1"), ("-x[0]", "-5")]),
]


@pytest.mark.parametrize(("content", "want"), CASES)
def test_settings(spark, content, want):
    rows = spark.createDataFrame([(content,)], "content string").select(F.inline(yaml.settings(F.col("content"))))
    assert [tuple(r) for r in rows.collect()] == want


def test_null_wanted_and_many_lines(spark):
    long = "a:\n" + "".join(f"  k{i}:\n    url: u{i}\n    other: {i}\n" for i in range(3_000))
    rows = spark.createDataFrame([(1, None), (2, long)], "id int, content string")
    got = rows.select("id", F.inline_outer(yaml.settings(F.col("content"), r"\.url$"))).collect()
    assert [tuple(r) for r in got if r["id"] == 1] == [(1, None, None)]
    assert [tuple(r)[1:] for r in got if r["id"] == 2] == [(f"a.k{i}.url", f"u{i}") for i in range(3_000)]


def test_bindings_of_nested_yaml(spark, files, rows):
    app = "@SpringBootApplication\nclass A {}"
    nested = (
        "spring:\n  cloud:\n    stream:\n      bindings:\n        input:\n          destination: orders\n          group: order-processor\n"
        "        output:\n          destination: processed-orders\n"
    )
    corpus = files(("s/A.java", app), ("s/application.yml", nested), ("t/application.yml", nested))
    want = {("s/application.yml", "input", "orders", "consumer"), ("s/application.yml", "output", "processed-orders", "producer")}
    assert rows(extraction.stream_bindings(corpus), "path", "binding", "topic", "role") == want
