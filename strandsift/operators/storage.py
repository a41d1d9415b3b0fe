"""Tables that a plan writes and reads again, in the folder that all executors share.

Such a table is deleted by ``forget`` or, where a result still reads it, when
the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a local one, which only a local master can share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master.startswith("local-cluster") or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="strandsift-")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandsift-{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete_at_end(spark: SparkSession, path: str) -> None:
    """The folder ``path``, which exists, goes when the application ends."""
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)


def delete_now(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


def materialised(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` once and reads it back: cuts the lineage, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    delete_at_end(spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._strandsift_path = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes a materialised table that nothing will read again."""
    path = getattr(df, "_strandsift_path", None)
    if path:
        delete_now(df.sparkSession, path)
