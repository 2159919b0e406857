import hashlib
import random

from topicloom.llm import warc


def sha1(x):
    return hashlib.sha1((x or "").encode()).hexdigest()


def brute(rows):
    out = []
    for i, _, html in rows:
        n = len((html or "").encode())
        same = [j for j, _, h in rows if h == html and j is not None]
        top = max(same) if same and i is not None else i
        revisit = n >= 1000 and i is not None and i < top
        out.append((i, n, sha1(html), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def fake(i):
    """A payload that holds whole records and their beginnings."""
    inner = "HTTP/1.1 200 OK\r\n\r\ninside"
    record = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(inner)}\r\n\r\n{inner}\r\n\r\n"
    return f"é{i} " * 40 + record + "WARC/1.0\r\nWARC-Type: x" + record * 2 + "WARC/1.0\r\n" + "tail" * (i % 9)


def pages():
    r = random.Random(1)
    rows = [(i, f"http://x/{i} y", "".join(r.choice("abc é\r\n") for _ in range(r.randrange(0, 900)))) for i in range(30)]
    rows += [(100 + i, None, "same long page " * 100) for i in range(30)]
    rows += [(200 + i, "u\r\nWARC-Type: bad", fake(i % 7)) for i in range(25)]
    return rows + [(300, "u", None), (301, "u", ""), (302, "u", "WARC/1.0\r\n"), (303, "u", "\r\n\r\n"), (-4, "u", "x" * 999),
                   (-5, "u", "x" * 999), (304, "u", "x" * 20_000), (305, "u", "x" * 20_000), (None, "u", "x" * 2000)]


def test_round_trip(spark, tmp_path):
    rows = pages()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    path = str(tmp_path / "a")
    warc.write_archives(frame, path, records_per_file=50)
    try:
        for size in ("128m", "1999"):  # blocks that cut records, headers and the magic
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size != "128m" else "4m")
            got = warc.page_records(warc.read_archives(spark, path)).collect()
            assert sorted(map(tuple, got), key=repr) == brute(rows), size
            if size == "1999":
                whole = warc.read_archives(spark, path, payload=True).where("type = 'response'").collect()
                assert {(r.id, bytes(r.payload).decode()) for r in whole} == {
                    (f"<urn:page:{'' if i is None else i}>", h or "")
                    for i, _, h in rows
                    if i is None or (i, "response") in {(x[0], x[3]) for x in brute(rows)}
                }
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "p" * 1500, "z", 3)] * 3 + [(0, "u", "p" * 1500, "z", 3)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, id string, refers_to int")
    warc.write_archives(frame, str(tmp_path / "b"))
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in
           warc.page_records(warc.read_archives(spark, str(tmp_path / "b"))).collect()]
    assert sorted(got, key=repr) == [(0, 1500, "revisit", 1)] + [(1, 1500, "response", None)] * 3


def test_empty(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(frame, str(tmp_path / "c"))
    assert warc.page_records(warc.read_archives(spark, str(tmp_path / "c"))).count() == 0


def test_chain_of_many_records(spark):
    links = spark.createDataFrame(
        [("f", 10 * i, 10 * i + 10) for i in range(300)] + [("f", 10 * i + 5, 10 * i + 10) for i in range(300)] + [("g", 3, 9)],
        "file string, off bigint, next bigint",
    )
    got = {(r.file, r.off) for r in warc.reachable(links).collect()}
    assert got == {("f", 10 * i) for i in range(300)}
