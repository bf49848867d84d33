"""Time the headline queries: one warm-up scan, then each query once, results written nowhere.

Prints one JSON line. ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from checks.corpus import code_files  # noqa: E402
from checks.queries import queries  # noqa: E402
from siftspark.operators import extract  # noqa: E402

HEADLINES = (
    "findings_scoped", "findings_enriched", "all_candidates", "raw_findings", "line_explode",
    "predicate_flags", "symbols", "exception_blocks_scoped", "logger_calls", "corpus_scan",
    "skip_ledger", "dedupe_candidates", "suppress", "fingerprint_dedupe", "ordered_findings",
    "redact_text", "snippet_windows", "first_snippets", "snippets_per_file", "prompt_batches",
    "response_parse", "validate_external", "merge_findings", "by_rule", "scan_summary",
    "evaluate", "export_json", "export_markdown", "scan_stream",
)


def spent(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def spread_copy(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The tables with ``documents`` in several files: here it is one row group, which one task would read."""
    folder = tempfile.mkdtemp(prefix="siftspark-bench-")
    for path in Path(sf_dir).glob("*.parquet"):
        if path.stem != "documents":
            (Path(folder) / path.name).symlink_to(path)
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(files, "doc_id").write.parquet(
        f"{folder}/documents.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("siftspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, given = spread_copy(spark, sf_dir, 2 * int(cpus)), sf_dir
    registered = queries()
    spent(registered["findings_scoped"](spark, sf_dir))
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        spent(registered[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    files = code_files(spark, sf_dir)
    n_files, n_lines = files.count(), extract.lines(files).count()
    scan = times["findings_scoped"]
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": given.rstrip("/").rsplit("sf", 1)[-1],
        "files": n_files, "lines": n_lines,
        "scan_files_per_sec": round(n_files / scan, 1),
        "scan_lines_per_sec": round(n_lines / scan, 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
