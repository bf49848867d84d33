"""Counts, gates and evaluation. Every aggregate collapses inside its task before it is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import text as T
from siftspark.functions.text import SEVERITIES
from siftspark.operators.findings import deduped_array, finding_array
from siftspark.operators.snippets import snippet_array
from siftspark.options import ScanOptions


def by_severity(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy("severity").agg(F.count("*").alias("findings"))


def by_severity_filled(enriched: DataFrame, repos: DataFrame) -> DataFrame:
    """Five rows for each repo of ``repos``, zero where nothing was found."""
    counts = enriched.groupBy("repo").agg(
        *[F.count_if(F.col("severity") == name).alias(name) for name in SEVERITIES])
    whole = repos.select("repo").distinct().join(counts, "repo", "left").fillna(0, list(SEVERITIES))
    return whole.unpivot(["repo"], list(SEVERITIES), "severity", "findings")


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule_id").agg(F.count("*").alias("findings"))


def files_by_language(files: DataFrame) -> DataFrame:
    """(repo, files_by_language): a map with as many entries as there are languages."""
    counts = files.groupBy("repo", "language").agg(F.count("*").alias("files"))
    return counts.groupBy("repo").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("language", "files")))).alias("files_by_language"))


def by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"))


def total_loc(files: DataFrame) -> DataFrame:
    return files.select(F.expr(f"size({T.split_lines('text')})").alias("loc")).agg(
        F.sum("loc").alias("total_loc"))


def scan_summary(files: DataFrame, ledger: DataFrame | None = None,
                 options: ScanOptions = ScanOptions()) -> DataFrame:
    """One row per repo: files, lines, findings, snippets, skipped files.

    Each file is reduced to four numbers in the scan itself; the text is read once, its hits are found
    once, and nothing but the numbers is shuffled.
    """
    return summary_of(scanned(files, options), ledger)


def scanned(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """One row per file without its text: lines, number of snippets, and ``found``, its processed findings.

    Written once it gives both the summary (``summary_of``) and the findings (``findings.found_in``).
    """
    matched = files.selectExpr("repo", "path", "language", "text", f"{deduped_array(options)} AS hits")
    return matched.selectExpr(
        "repo", "path", "language", f"cast(size({T.split_lines('text')}) AS bigint) AS loc",
        f"{finding_array(options, hits='hits')} AS found",
        f"cast(size({snippet_array(options, bodies=False, hits='hits')}) AS bigint) AS snips")


def summary_of(once: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """``scan_summary`` of files that are ``scanned`` already."""
    numbers = once.selectExpr(
        "repo", "1L AS files", "loc", "cast(size(found) AS bigint) AS found", "snips", "0L AS skipped")
    if ledger is not None:
        numbers = numbers.unionByName(ledger.selectExpr(
            "repo", "0L AS files", "0L AS loc", "0L AS found", "0L AS snips", "1L AS skipped"))
    return numbers.groupBy("repo").agg(
        F.sum("files").alias("files_scanned"), F.sum("loc").alias("total_loc"),
        F.sum("found").alias("findings"), F.sum("snips").alias("snippets"),
        F.sum("skipped").alias("skipped_files"))


def severity_gate(enriched: DataFrame, repos: DataFrame, threshold: str | None) -> DataFrame:
    """(repo, exit_code): 1 if a finding is as bad as the threshold, 2 for an unknown threshold."""
    names = repos.select("repo").distinct()
    if not threshold:
        return names.withColumn("exit_code", F.lit(0))
    if threshold not in SEVERITIES:
        return names.withColumn("exit_code", F.lit(2))
    worst = enriched.groupBy("repo").agg(F.min(F.expr(T.severity_rank("severity"))).alias("worst"))
    limit = SEVERITIES.index(threshold)
    return names.join(worst, "repo", "left").selectExpr(
        "repo", f"CASE WHEN coalesce(worst <= {limit}, false) THEN 1 ELSE 0 END AS exit_code")


# -------------------------------------------------------------------------------------- evaluation

def confusion(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Distinct (case, rule_id, line) with two flags: reported and expected.

    One aggregate over the union of both sides does the two distincts and their comparison with a
    single shuffle on the full key.
    """
    both = (
        actual.selectExpr("case", "rule_id", "line", "1 AS reported", "0 AS wanted",
                          "coalesce(evidence_valid, false) AS evidence_valid")
        .unionByName(expected.where("rule_id IS NOT NULL").selectExpr(
            "case", "rule_id", "line", "0 AS reported", "1 AS wanted", "false AS evidence_valid")))
    return both.groupBy("case", "rule_id", "line").agg(
        F.max("reported").alias("reported"), F.max("wanted").alias("wanted"),
        F.max("evidence_valid").alias("evidence_valid"))


def totals(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(
        F.sum("reported").alias("actual_total"), F.sum("wanted").alias("expected_total"),
        F.sum(F.col("reported") * F.col("wanted")).alias("matched_total"),
        F.count_if(F.col("evidence_valid") & (F.col("reported") == 1)).alias("valid_total"))


def ratios(counted: DataFrame, *keys: str) -> DataFrame:
    """Precision, recall and the derived rates of ``totals``."""
    shares = counted.selectExpr(
        *keys, "actual_total", "expected_total", "matched_total",
        "CASE WHEN actual_total > 0 THEN matched_total / actual_total ELSE 1D END AS p",
        "CASE WHEN expected_total > 0 THEN matched_total / expected_total ELSE 1D END AS r",
        "CASE WHEN actual_total > 0 THEN valid_total / actual_total ELSE 1D END AS v")
    return shares.selectExpr(
        *keys, "actual_total", "expected_total", "matched_total",
        "round(p, 4) AS precision", "round(r, 4) AS recall",
        "round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0D END, 4) AS f1",
        "round((actual_total - matched_total) / greatest(actual_total, 1), 4)"
        " AS false_positive_rate",
        "round((expected_total - matched_total) / greatest(expected_total, 1), 4)"
        " AS false_negative_rate",
        "round(v, 4) AS evidence_validity")


def evaluate(actual: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the ratios plus rule coverage, line accuracy and findings per thousand lines.

    Totals are taken per rule and then over the few rules, so pairs are built once for both the
    ratios and the coverage.
    """
    per_rule = totals(confusion(actual, expected), "rule_id")
    counted = per_rule.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("actual_total", "expected_total", "matched_total", "valid_total")],
        F.count_if(F.col("matched_total") > 0).alias("hit_rules"),
        F.count_if(F.col("expected_total") > 0).alias("rules"))
    coverage = "round(CASE WHEN rules > 0 THEN hit_rules / rules ELSE 1D END, 4) AS rule_coverage"
    return ratios(counted.selectExpr("*", coverage), "rule_coverage").selectExpr(
        "*", "recall AS line_accuracy").withColumn(
        "findings_per_kloc", F.round(F.col("actual_total") / F.greatest(
            total_loc(files).scalar() / F.lit(1000.0), F.lit(0.001)), 2))


def with_evidence_check(found: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``evidence_valid`` to findings that come without their file: every line of the
    evidence occurs in it. Only files named by a finding keep their text for the join.

    Findings that the scan makes itself carry the flag from ``findings.checked_findings``.
    """
    named = found.select("repo", "path").distinct()
    texts = files.join(named, ["repo", "path"], "left_semi").select("repo", "path", "text")
    return found.join(texts, ["repo", "path"], "left").withColumn(
        "evidence_valid", F.expr(f"coalesce({T.occurs('evidence', 'text')}, false)")).drop("text")
