"""Stage tables: write a result once, read it back as a plain Parquet scan.

A stage table cuts lineage (it survives lost executors), is computed once however
often it is used, and has an exact file size, so the optimizer's broadcast
threshold is a true size check for every join against it. Beyond that size both
sides of such a join are shuffled directly below it, the form in which a hot key is
split at run time; a side that ends in an aggregation on the join key is not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


# Temporary folders of local applications; no session setting is touched.
_LOCAL_FOLDERS: dict[str, str] = {}
# The run that owns the stage tables made now (see sources.stages), if any.
OWNER: ContextVar = ContextVar("stage tables' owner", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="agriclime-")
    return _LOCAL_FOLDERS[application]


def application_folder(spark: SparkSession) -> str:
    """Where the stage tables of this application lie."""
    return f"{shared_folder(spark).rstrip('/')}/agriclime-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def remove_stage_tables(spark: SparkSession) -> None:
    """Delete the stage tables of this application, once its results are written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(application_folder(spark))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.getFileSystem(conf).delete(hadoop, True)


def partitioned_writer(df: DataFrame, partition_by: Sequence[str], rebalance: bool = True):
    """A writer with one folder per key and files of a sensible size.

    Without the rebalance every task would add a file to every folder. It shuffles
    by the key but splits a large key over many tasks, so no year ends up in one.
    """
    if not partition_by:
        return df.write
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    return df.write.partitionBy(*partition_by)


def materialize(
    df: DataFrame,
    label: str = "stage",
    path: str | None = None,
    partition_by: Sequence[str] = (),
    rebalance: bool = True,
) -> DataFrame:
    """Write ``df`` as Parquet and return a scan of what was written.

    Inside a ``StageRun`` a table without ``path`` belongs to that run, which may hold it
    already.
    """
    spark = df.sparkSession
    owner = OWNER.get()
    if owner is not None and path is None:
        return owner.stage(df, label, partition_by, rebalance)
    target = path or new_path(spark, label)
    writer = partitioned_writer(df, partition_by, rebalance)
    writer.mode("overwrite" if path else "error").parquet(target)
    return spark.read.schema(df.schema).parquet(target).select(*df.columns)
