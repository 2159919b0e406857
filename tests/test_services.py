import pytest
from pyspark.sql import functions as F

from topicloom.functions import text
from topicloom.operators import services as s

NAMED_POM = '<project xmlns="http://maven.apache.org/POM/4.0.0"><artifactId>foo service</artifactId></project>'


@pytest.mark.parametrize(
    "extract, path, content, want",
    [
        (s.java_service_name, "a/pom.xml", "<project><artifactId>test-service</artifactId></project>", "test-service"),
        (s.java_service_name, "services/java-service/pom.xml", NAMED_POM, "java-service"),
        (s.java_service_name, "a/b/pom.xml", "not xml <artifactId", "b"),
        (s.java_service_name, "a/build.gradle", "rootProject.name = 'test-service'", "test-service"),
        (s.java_service_name, "a/build.gradle.kts", 'rootProject.name = "x"', "a"),
        (s.node_service_name, "a/package.json", '{"name": "@scope/test-service"}', "test-service"),
        (s.node_service_name, "fallback/package.json", "{}", "fallback"),
        (s.node_service_name, "fallback/package.json", "{bad", "fallback"),
        (s.python_service_name, "a/setup.py", "setup(name='test-service')", "test-service"),
        (s.python_service_name, "a/setup.py", "setup(version='1')", None),
        (s.python_service_name, "a/pyproject.toml", '[project]\nname = "Test_Service"', "test-service"),
        (s.python_service_name, "my_Dir/requirements.txt", "x", "my-dir"),
        (s.csharp_service_name, "a/t.csproj", "<P><AssemblyName>TestService</AssemblyName></P>", "test-service"),
        (s.csharp_service_name, "a/test-service.csproj", "broken", "test-service"),
    ],
)
def test_names(files, extract, path, content, want):
    got = files((path, content)).select(extract(F.col("path"), F.col("content")).alias("n")).first().n
    assert got == want


def test_discovery(files, rows):
    corpus = files(
        ("pom.xml", "<project/>"),
        ("services/java-service/pom.xml", NAMED_POM),
        ("services/java-service/package.json", '{"name": "web"}'),
        ("py/pyproject.toml", "[tool]\n"),
        ("py/requirements.txt", ""),
        ("cs/Foo.csproj", "<P/>"),
        ("tests/setup.py", "setup(name='t')"),
        ("tests/inner/setup.py", "setup(name='inner')"),
        ("none/readme.txt", ""),
    )
    got = rows(s.detect_services(corpus), "service", "root_path", "language")
    assert got == {
        ("java-service", "services/java-service", "java"),
        ("py", "py", "python"),
        ("foo", "cs", "csharp"),
        ("inner", "tests/inner", "python"),
    }


def _services(spark, *entries):
    return spark.createDataFrame(
        [(n, r, lang, None, stub) for n, r, lang, stub in entries],
        "service string, root_path string, language string, build_file string, is_stub boolean",
    )


def test_assignment_matches_nested_roots_and_skips_stubs(spark, files, rows):
    known = _services(
        spark, ("outer", "a", "java", False), ("inner", "a/b/c", "java", False), ("stub", "a", "unknown", True)
    )
    corpus = files(("a/x.java", ""), ("a/b/c/y.java", ""), ("ab/z.java", ""), ("x.java", ""))
    assert rows(s.assign_files(corpus.select("path"), known), "path", "service") == {
        ("a/x.java", "outer"), ("a/b/c/y.java", "outer"), ("a/b/c/y.java", "inner"),
    }


def test_source_files(spark, files, rows):
    known = _services(spark, ("j", "j", "java", False), ("w", "w", "javascript", False))
    corpus = files(("j/A.java", ""), ("j/src/test/B.java", ""), ("j/c.py", ""), ("w/a.ts", ""), ("w/b.js", ""))
    assert rows(s.source_files(corpus, known), "service", "path") == {
        ("j", "j/A.java"), ("w", "w/a.ts"), ("w", "w/b.js"),
    }


def test_last_registration_wins(spark, rows):
    regs = _services(spark, ("test", "/test1", "java", False), ("test", "/test2", "python", False))
    assert rows(s.upsert_services(regs), "service", "root_path", "language") == {("test", "/test2", "python")}


@pytest.mark.parametrize(
    "function, value, want",
    [
        (text.sanitize_name, "My Big_ServiceName!", "my-big-service-name"),
        (text.sanitize_name, None, ""),
        (text.kebab, "UserServiceClient", "user-service-client"),
        (text.clean_node_id, "#{", "topic_hash"),
        (text.clean_node_id, "${a.b-c}", "a_b_c"),
        (text.clean_node_id, "x$y {z}#@:/\\", "x$y_zhashat___"),
        (text.format_topic_name, "#{", "hash_topic"),
        (text.format_topic_name, "M", "M"),
        (text.format_topic_name, "${kafka.streams.x.target-topic}", "kafka.streams...target"),
        (text.format_topic_name, "app.a.event.b.c", "app...b"),
        (text.format_topic_name, "app.a.event", "app...event"),
        (text.format_topic_name, "app.a.z", "app...z"),
        (text.format_topic_name, "${config.kafka.z}", "config.kafka...z"),
        (text.format_topic_name, "orders", "orders"),
        (text.suffix, "a.b/c.TAR.Gz", ".gz"),
        (text.suffix, "a.b/c", ""),
        (text.parent_dir, "a/b/c.java", "a/b"),
        (text.parent_dir, "c.java", ""),
    ],
)
def test_text_functions(spark, function, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(function(F.col("v")).alias("r")).first().r == want
