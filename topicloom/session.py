"""Session settings and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def builder(app: str = "topicloom") -> SparkSession.Builder:
    out = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost together with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="topicloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/topicloom/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step", **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative plans. Unlike a cached table it outlives lost
    executors, and the files give the planner true sizes for later joins. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``materialize`` wrote for ``df``."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df._scratch)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; later reads of it fail."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
