"""Source corpora as (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import catalogue as cat

# Read besides the source suffixes: build files and schema documents.
EXTRA_SUFFIXES = (".avsc", ".json", ".txt", ".toml", ".csproj", ".kts")


def name_glob(suffixes=cat.SOURCE_SUFFIXES + EXTRA_SUFFIXES) -> str:
    """One file-name glob for the listing, in any letter case."""
    either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "{" + ",".join("*" + e for e in either) + "}"


def clean_texts(files: DataFrame) -> DataFrame:
    """Drop unreadable (not UTF-8) texts and unify line ends."""
    return files.where(F.is_valid_utf8("content")).withColumn(
        "content", F.regexp_replace("content", "\r\n?", "\n")
    )


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length, mtime) of all text files below ``root``.

    Suffixes are tested while listing, so other files are never opened. ``path``
    is relative to the root. Empty files are kept: they count as source files but
    hold no matches.
    """
    base = root.rstrip("/")
    # a file may go while the job runs; a failing read is retried and then fails the job
    listed = spark.read.option("ignoreMissingFiles", True).text(
        base, wholetext=True, recursiveFileLookup=True, pathGlobFilter=name_glob()
    )
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    top = base if "://" in base else "/" + base.removeprefix("file:").lstrip("/")
    files = listed.select(
        F.substring(plain, len(top) + 2, 1 << 30).alias("path"),
        F.col("value").alias("content"),
        F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("mtime"),
    )
    return clean_texts(files)


def table_corpus(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Any table with a path and a text column as a corpus.

    The form to prefer at scale: millions of small files are slow to list, while
    a columnar table of texts splits and prunes.
    """
    return clean_texts(df.select(F.col(path).alias("path"), F.col(content).alias("content")))
