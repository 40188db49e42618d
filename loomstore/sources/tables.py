"""Parquet tables and intermediate tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary folder of its own; on a cluster that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
        folder = context._loomstore_folder = getattr(context, "_loomstore_folder", None) or tempfile.mkdtemp(prefix="loomstore-")
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def scratch(df: DataFrame, name: str, cluster_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage, and a lost executor loses nothing.

    ``cluster_by`` sorts each written part by these columns, so that later scans skip row groups.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(df: DataFrame) -> None:
    """Remove a table written by :func:`scratch` once its successor has been written."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
