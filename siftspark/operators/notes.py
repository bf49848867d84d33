"""Notes of all stages of a scan: (repo, stage, path, note).

What a file gives rise to is told in the pass that judges it: one row per file with its state and its note, if
any. Notes on whole repos follow from these rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.sql import lit, when
from siftspark.operators.extract import fell_back, with_lines
from siftspark.options import ScanOptions
from siftspark.sources.files import file_quality, reason_note, supported
from siftspark.sources.landing import landed

COLUMNS = ("repo", "stage", "path", "note")
NO_FILES = "No supported files were found."
NO_REVIEW = "Semantic analysis disabled for this scan."
FALLBACK = ": no exact block was found; line windows used."


def scan_notes(raw: DataFrame, options: ScanOptions = ScanOptions(), globs: tuple[str, ...] | None = None) -> DataFrame:
    """Files left out and why, files whose blocks are line windows for want of exact ones, repos without files.

    ``raw`` is (repo, path, length, content). A file limit leaves its own entry in ``files.skip_ledger``.
    """
    judged = file_quality(supported(raw, options, globs), options)
    text = "make_valid_utf8(cast(content AS string))"
    fallback = "false"
    if options.block_mode == "scoped":
        fallback = when("skip_reason IS NULL", with_lines(lambda ls: fell_back(ls, "language")))
    note = (f"CASE WHEN skip_reason IS NOT NULL THEN {reason_note(options)}"
            f" WHEN {fallback} THEN concat(path, {lit(FALLBACK)}) END")
    files = landed(judged.withColumn("text", F.expr(text)).selectExpr(
        "repo", "path", "skip_reason IS NULL AS accepted",
        "CASE WHEN skip_reason IS NOT NULL THEN 'scan' ELSE 'fallback' END AS stage", f"{note} AS note"), "file_notes")
    counts = files.groupBy("repo").agg(F.count_if("accepted").alias("n"))
    empty = raw.select("repo").distinct().join(counts, "repo", "left").where("coalesce(n, 0) = 0")
    return files.where("note IS NOT NULL").select(*COLUMNS).unionByName(
        empty.selectExpr("repo", "'scan' AS stage", "cast(NULL AS string) AS path", f"{lit(NO_FILES)} AS note"))


def disabled_notes(repos: DataFrame) -> DataFrame:
    """For scans without an external review: one note a repo."""
    return repos.select("repo").distinct().selectExpr(
        "repo", "'review' AS stage", "cast(NULL AS string) AS path", f"{lit(NO_REVIEW)} AS note")


def review_notes(proposals: DataFrame, rejected: DataFrame) -> DataFrame:
    """Answers that could not be read, items that are no findings, and findings that were turned down."""
    unread = proposals.where("note IS NOT NULL").selectExpr(
        "repo", "'review' AS stage", "cast(NULL AS string) AS path", "note")
    return unread.unionByName(rejected.selectExpr(
        "repo", "'review' AS stage", "path", "verdict_note AS note"))
