"""The scan on a stream of files. Everything up to a finding is stateless per file; what has been seen
before, and how often, is keyed state.

State lives in the checkpoint folder of a query, so a query that is stopped and started again goes on with
what it knew. State by key is spread over the executors by Spark; for more keys than fit into their memory set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider before the first start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftspark.operators.findings import findings
from siftspark.options import ScanOptions
from siftspark.sources.files import collect_files, unscanned


def stream_findings(raw: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Findings of streamed raw files. File limits need a total order and do not apply here."""
    if options.max_files is not None:
        raise ValueError("a file limit has no meaning on a stream")
    return findings(collect_files(raw, options), options)


def unseen(found: DataFrame, arrived: str, delay: str) -> DataFrame:
    """First occurrence of each fingerprint while its state is kept; ``delay`` bounds the state."""
    return found.withWatermark(arrived, delay).dropDuplicatesWithinWatermark(
        ["repo", "fingerprint"])


def first_seen(found: DataFrame) -> DataFrame:
    """First occurrence of each fingerprint of a repo, however long ago: its key stays in the state."""
    return found.dropDuplicates(["repo", "fingerprint"])


def new_files(files: DataFrame, seen_hashes: DataFrame | None = None) -> DataFrame:
    """Files whose content neither an earlier scan's table of hashes holds nor the stream has brought.

    The table is read again with each batch; hashes the stream has met are state.
    """
    fresh = files if seen_hashes is None else unscanned(files, seen_hashes)
    return fresh.dropDuplicates(["file_hash"])


def run_available(found: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived as parquet and stop; a restart goes on where it ended."""
    return (found.writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_counts(found: DataFrame, keys: tuple[str, ...], out: str, checkpoint: str) -> StreamingQuery:
    """Keep running counts of findings by ``keys`` in update mode and stop when all there is has been read.

    Each batch writes the counts that it changed to a folder of its own. A batch that is run again after a
    failure overwrites that folder, so nothing is counted twice.
    """
    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    counted = found.groupBy(*keys).agg(F.count("*").alias("findings"))
    return (counted.writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_counts(spark: SparkSession, out: str, keys: tuple[str, ...]) -> DataFrame:
    """The counts as they stand: of each key the row of its last batch."""
    changes = spark.read.parquet(out)
    return changes.groupBy(*keys).agg(F.max_by("findings", "batch").alias("findings"))
