from topicloom.operators import files as f


def test_source_files(files, rows):
    kept = ["a/B.java", "a/B.JAVA", "x/y.Py", "c.yml", "builds/a.ts", "pom.xml"]
    dropped = [
        "a/.git/B.java", ".hidden.py", "node_modules/x.js", "a/target/B.java", "a/build/c.kt",
        "README.md", "a/B", "x.avsc", "a/.x/b.java", "java",
    ]
    corpus = files(*[(p, "") for p in kept + dropped])
    assert rows(f.filter_source_files(corpus), "path") == {(p,) for p in kept}


def test_test_directories(spark, rows):
    paths = ["s/src/main/A.java", "s/src/test/A.java", "s/tests/b.py", "s/test/c.py", "s/src/tests/d.java"]
    owned = spark.createDataFrame([(p, "s") for p in paths], "path string, root_path string")
    assert rows(f.filter_test_dirs(owned), "path") == {("s/src/main/A.java",)}
    assert f.filter_test_dirs(owned, include_tests=True).count() == 5


def test_messaging_test_paths(files, rows):
    corpus = files(("a/src/test/A.java", ""), ("a/test/B.java", ""), ("a/tests/test_data/C.java", ""), ("a/D.java", ""))
    assert rows(f.filter_messaging_test_paths(corpus), "path") == {("a/tests/test_data/C.java",), ("a/D.java",)}


def test_applicable_and_ignored(files, rows):
    corpus = files(
        ("a/App.java", "@SpringBootApplication class App {}"),
        ("a/Rest.java", '@RestController @GetMapping("/{id}")'),
        ("a/Listen.java", '@StreamListener("c")'),
        ("a/Plain.java", "class Plain {}"),
        ("a/x.py", "@SpringBootApplication"),
    )
    got = rows(f.applicable_files(corpus))
    assert {p for p, a in got if a == "spring"} == {"a/App.java", "a/Rest.java", "a/Listen.java"}
    assert {p for p, a in got if a == "java"} == {"a/App.java", "a/Rest.java", "a/Listen.java", "a/Plain.java"}
    assert len([1 for _, a in got if a == "generic"]) == 5
    ignored = files(("T.java", "@SpringBootTest"), ("U.java", "x"))
    assert rows(f.ignore_by_content(ignored), "path") == {("U.java",)}


def test_rest_endpoints(files, rows):
    corpus = files(
        ("R.java", '@RestController\n@RequestMapping("/api")\n@DeleteMapping(\'/x\')'),
        ("M.java", "@Controller class M {}"),
        ("N.java", "class N {}"),
    )
    assert rows(f.rest_endpoints(corpus)) == {
        ("R.java", "REQUEST", "/api"), ("R.java", "DELETE", "/x"), ("M.java", None, None),
    }
