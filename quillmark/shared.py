"""Session helpers: table loading and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Where the session has none, a temporary folder is set, but only for a
    single-machine master: on a cluster a machine-local folder would be lost
    with its machine.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quillmark-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the driver's JVM ends."""
    base = f"{shared_dir(spark)}/quillmark-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return base


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage; unlike a local checkpoint it survives the loss of any
    executor, and Parquet keeps it smaller than a checkpoint's row format.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with at least one row in so many is hot: there are at most so many of them.
HOT_KEYS = 1000


def join_hot(rows: DataFrame, facts: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with one fact per key, safe under hot keys.

    ``weight`` is a column of ``facts``: how many rows have the key. Keys that
    hold more than a thousandth of all rows are at most ``HOT_KEYS``, so their
    facts are broadcast whatever the data's size; all other keys meet in a
    shuffle.
    """
    from pyspark.sql import functions as F

    total = facts.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * HOT_KEYS >= F.lit(total)
    hot, cold = facts.where(is_hot), facts.where(~is_hot)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))
