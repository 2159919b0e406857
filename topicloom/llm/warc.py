"""WARC archives: writing with revisit records, splittable reading with boundary-chain verification.

Writing: one record a row through Spark's text writer, whose line separator is the CRLF CRLF
that ends a record; so files go wherever Spark can write and payloads keep their bytes.

Reading: files are cut at every ``WARC/1.0 CRLF``, the magic, also where a payload holds it.
Tasks read byte ranges and emit, for each such candidate, its offset and, if a header
follows, the offset at which its successor must start. The start of a file is a record;
from there pointer jumping marks what the chain reaches, in rounds that double the distance
(each written to the shared folder). Candidates that are not reached lie inside payloads.
A record cut by a magic in its payload is put together again from its pieces.

Defined results: a null payload is empty; a null or odd URI is left out or percent-encoded;
a null id gives a record without a usable id (null again when read); of rows with equal
payloads of at least ``REVISIT_BYTES`` bytes, those with the largest id are responses, rows
that repeat that id included, and the others revisit it; no rows give no archive and an empty
result; further columns of the input are not looked at. A chain that meets a damaged header
ends there, and what the damage makes unreachable is not returned.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.llm.base import query, table
from topicloom.operators.skew import salted_join
from topicloom.session import materialize, scratch_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
ID = "urn:page:"
REVISIT_BYTES = 1000
FILE_RECORDS = 10_000


def _header(name: str, value: Column) -> Column:
    """A header line; none for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def plan_revisits(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(id, refers_to) of the rows whose payload is stored with a larger id."""
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keyed = pages.select(F.col(id_col).alias("id"), F.octet_length(body).alias("n"), F.sha1(body).alias("digest")).where(
        F.col("n") >= REVISIT_BYTES
    )
    keyed = materialize(keyed.select("id", F.unhex("digest").alias("digest")), "digests")
    shared = keyed.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return salted_join(keyed, shared.drop("n"), ["digest"]).where("id < refers_to").select("id", "refers_to").distinct()


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url",
    records_per_file: int = FILE_RECORDS,
) -> None:
    """A response or revisit record for every row."""
    revisits = materialize(plan_revisits(pages, id_col, payload_col), "revisits")
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    rows = pages.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
        F.regexp_replace(F.regexp_replace(F.regexp_replace(uri, "\r", "%0D"), "\n", "%0A"), " ", "%20").alias("uri"),
    ).join(revisits, "id", "left")  # the planner broadcasts the revisits if their files are small
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("uri")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("payload").cast("binary")))),
        _header("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
    )
    rows.select(F.concat(head, F.lit("\r\n"), block).alias("value")).write.option("lineSep", END).option(
        "maxRecordsPerFile", records_per_file
    ).text(path)


# --- reading -----------------------------------------------------------------

_LENGTH = re.compile(rb"(?i)(?:^|\r\n)content-length:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n|$)")


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def parse_record(chunk: bytes) -> dict:
    """What one piece of a file, from behind a magic up to the next, says about a record.

    ``need`` is how many bytes of the file the record takes from behind its magic, the final
    CRLF CRLF included, or null if no header starts here; the rest is null if bytes are missing.
    """
    out = dict.fromkeys(("need", "type", "id", "refers_to", "uri", "digest", "bytes", "sha1", "payload"))
    head, gap, rest = chunk.partition(b"\r\n\r\n")
    length = _LENGTH.search(head) if gap else None
    if length is None:
        return out
    size = int(length[1])
    out["need"] = len(head) + 4 + size + 4
    fields = _fields(head)
    out |= {
        "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "refers_to": fields.get("warc-refers-to"),
        "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"),
    }
    if len(rest) >= size:
        body = rest[:size]
        if fields.get("content-type", "").startswith("application/http"):
            body = body.partition(b"\r\n\r\n")[2]
        out |= {"bytes": len(body), "sha1": hashlib.sha1(body).hexdigest(), "payload": body}
    return out


_RECORD = "need bigint, type string, id string, refers_to string, uri string, digest string, bytes bigint, sha1 string, payload binary"


def _arrays(records: list[dict], payload: bool) -> list[pa.Array]:
    kinds = {"need": pa.int64(), "bytes": pa.int64(), "payload": pa.binary()}
    names = [c.split()[0] for c in _RECORD.split(", ")]
    return [
        pa.array([r[n] if n != "payload" or payload else None for r in records], kinds.get(n, pa.string())) for n in names
    ]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece): the files cut at the magic, each block's pieces in file order."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("piece"),
    )


def _with_offsets(rows: DataFrame) -> DataFrame:
    """Add ``off``, the file offset of a piece's magic, to rows with a place ``within`` the block.

    All pieces and the magics between them make up the file, so a block's first piece
    starts where the pieces of the blocks before it end.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total")).select(
        "file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")
    )
    return rows.join(blocks, ["file", "block"]).withColumn("off", F.col("base") + F.col("within") - len(MAGIC)).drop("base")


def _scan(spark: SparkSession, path: str, payload: bool, raw: bool) -> DataFrame:
    """(file, block, within, size, record..., raw) of every piece."""

    def run(batches):
        at, place = None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                files, blocks, chunks = (c.to_pylist() for c in part.columns)
                within, parsed = [], []
                for f, b, chunk in zip(files, blocks, chunks):
                    if (f, b) != at:
                        at, place = (f, b), 0
                    within.append(place)
                    place += len(chunk) + len(MAGIC)
                    # what stands before the first magic of a file is no record
                    parsed.append(parse_record(chunk if b or within[-1] else b""))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(within, pa.int64()), pa.array(map(len, chunks), pa.int64()),
                     *_arrays(parsed, payload), part.column(2) if raw else pa.nulls(len(chunks), pa.binary())],
                    names=names,
                )

    schema = f"file string, block bigint, within bigint, size bigint, {_RECORD}, raw binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return _pieces(spark, path).mapInArrow(run, schema)


def reachable(links: DataFrame) -> DataFrame:
    """(file, off) that the chain of ``links`` (file, off, next) reaches from offset 0.

    Pointer jumping: a round marks what the marked ones point to and doubles every pointer,
    so n records take about log2(n) rounds, however they lie over blocks and tasks.
    """
    state = materialize(links.select("file", "off", "next", (F.col("off") == 0).alias("reached")), "chain")
    while not state.where("reached AND next IS NOT NULL").isEmpty():
        targets = state.select("file", F.col("off").alias("next"), F.col("next").alias("further"))
        marks = state.where("reached AND next IS NOT NULL").select("file", F.col("next").alias("off"), F.lit(True).alias("mark"))
        stepped = state.join(targets, ["file", "next"], "left").join(marks.distinct(), ["file", "off"], "left")
        state = materialize(
            stepped.select(
                "file", "off", F.col("further").alias("next"), (F.col("reached") | F.coalesce("mark", F.lit(False))).alias("reached")
            ),
            "chain",
        )
    return state.where("reached").select("file", "off")


def _assembled(spark: SparkSession, path: str, broken: DataFrame, payload: bool) -> DataFrame:
    """Records (file, off, need) again, from all the pieces between their magic and their end."""
    whole = _with_offsets(_scan(spark, path, payload=False, raw=True)).select("file", "off", "size", "raw")
    starts = broken.select("file", "off", F.struct("off", "need").alias("rec"))
    order = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owner = whole.select("file", "off").join(starts, ["file", "off"], "left").select(
        "file", "off", F.last("rec", ignorenulls=True).over(order).alias("rec")
    )
    inside = owner.where(F.col("off") < F.col("rec.off") + len(MAGIC) + F.col("rec.need"))
    parts = whole.join(inside, ["file", "off"]).groupBy("file", F.col("rec.off").alias("off")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("off").alias("at"), "raw"))).alias("parts")
    )

    def run(batches):
        for batch in batches:
            glued = [MAGIC.encode().join(p["raw"] for p in row) for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *_arrays([parse_record(x) for x in glued], payload)], names=names
            )

    schema = f"file string, off bigint, {_RECORD}"
    names = [c.split()[0] for c in schema.split(", ")]
    return parts.mapInArrow(run, schema)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record: file, off, type, id, refers_to, uri, digest (as the header has it),
    bytes and sha1 of the payload that is there, and the payload itself if asked for."""
    names = [c.split()[0] for c in _RECORD.split(", ")]
    scanned = materialize(_scan(spark, path, payload, raw=False).drop("raw"), "candidates")
    found = _with_offsets(scanned).where("need IS NOT NULL")
    links = found.select("file", "off", (F.col("off") + len(MAGIC) + F.col("need")).alias("next"))
    records = found.join(reachable(links), ["file", "off"]).select("file", "off", *names)
    broken = records.where("bytes IS NULL").select("file", "off", "need")
    if not broken.isEmpty():
        records = records.where("bytes IS NOT NULL").unionByName(_assembled(spark, path, broken, payload))
    return records.drop("need") if payload else records.drop("need", "payload")


def page_records(records: DataFrame, kind: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes its
    payload's size from the response it names."""
    number = lambda c: F.regexp_extract(c, f"^<{ID}(-?[0-9]+)>$", 1)
    rows = records.select(
        F.nullif(number("id"), F.lit("")).cast(kind).alias("page_id"), F.col("type").alias("record_type"),
        F.nullif(number("refers_to"), F.lit("")).cast(kind).alias("refers_to"), "bytes", "sha1", "digest",
    )
    rows = materialize(rows, "records")
    revisits, others = rows.where("record_type = 'revisit'"), rows.where("record_type <> 'revisit'")
    named = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    sizes = others.join(named, "page_id", "left_semi").groupBy(F.col("page_id").alias("refers_to")).agg(
        F.max("bytes").alias("n")
    )
    filled = salted_join(revisits, sizes, ["refers_to"], "left")
    return others.select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to"
    ).unionByName(
        filled.select(
            "page_id", F.col("n").alias("payload_bytes"), F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
            "record_type", "refers_to",
        )
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM m"""


@query("op1_warc", ORACLE)
def warc(spark, sf):
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf, "pages"), path)
    return page_records(read_archives(spark, path))
