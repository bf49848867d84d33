"""Cut lineage by writing: a result used several times is computed once and read back as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it in ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own, since its tasks share this machine.
    Any other session raises: files in a machine-local folder would be lost to the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="siftspark-"))
    return context.getCheckpointDir().rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A new path for one run below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def bucketed(df: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``keys``, each task its own rows: a join on them then moves the
    other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *keys).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def landed(df: DataFrame, name: str = "landed") -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it from there.

    The files outlive the executors that wrote them, so later steps never go back to the corpus.
    """
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
