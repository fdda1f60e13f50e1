"""The folder shared by all executors, and lineage cuts in it."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_watched: list[SparkSession] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it.

    Where it is unset, a folder of our own in local mode only: the executors
    of a cluster would each write to a disk of their own.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints")
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/loom-{uuid.uuid4().hex}"
    if not _watched:
        _watched.append(spark)
        atexit.register(_clean, spark)
    _made.append(path)
    return path


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage, so that an executor lost later costs a reread and not a
    recomputation, and lets several consumers share one evaluation.
    """
    path = shared_path(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once no one will read it again."""
    for df in written:
        path = getattr(df, "written_to", None)
        if path in _made:
            _made.remove(path)
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession) -> None:
    try:
        for path in _made:
            _delete(spark, path)
    except Exception:  # the session has ended already; whoever owns the folder cleans it
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
