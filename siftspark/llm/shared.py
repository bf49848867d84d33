"""Helpers that several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD_BREAKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent a local session gets a folder of its own; any other session is an
    error, because a machine-local folder would be lost to the other machines.
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


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder below the shared one and read it from there.

    Cuts the lineage: executors lost later cost no step before this one.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` as a table bucketed by ``key``: joins on it then move the other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so other columns can't clash; null text is empty."""
    return docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")


def words_of(text: str) -> list[bytes]:
    """Runs of anything but space, tab, LF, VT, FF and CR, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never part equal values of ``column`` (the input is sorted by it)."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            values = table.column(column).to_numpy()
            edge = int(np.searchsorted(values, values[-1])) if len(values) else 0
            if edge:
                yield table.slice(0, edge)
                table = table.slice(edge)
            held, count = table.to_batches(), 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks()
