"""Reports as ordered text rows.

A report is not gathered into one value: a repo may hold a third of all findings. It is a table of
fragments (repo, section, ..., text); written in order, the part files of a repo concatenate to one
valid document. Only headers aggregate, and those are counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import text as T
from siftspark.functions.patterns import REDACTIONS, Redaction
from siftspark.functions.sql import let, lit, strings, struct
from siftspark.functions.text import SEVERITIES
from siftspark.options import ScanOptions

TOOL, VERSION = "siftspark", "0.1.0"
TITLE = "Code Hygiene Report"
FORMATS = ("markdown", "json", "sarif", "html")
EXTENSION = {"markdown": "md", "json": "json", "sarif": "sarif", "html": "html"}
PLACE = ("repo", "section", "rank", "path", "line", "rule_id", "seq", "fingerprint")
_EMPTY = {"rank": "0", "path": "''", "line": "0", "rule_id": "''", "seq": "0L", "fingerprint": "''"}
_FEED = lit("\n")


def _fragment(df: DataFrame, section: int, text: str, **place: str) -> DataFrame:
    fields = {**_EMPTY, **place}
    return df.selectExpr("repo", f"{section} AS section",
                         *[f"{v} AS {k}" for k, v in fields.items()], f"{text} AS text")


def _finding_place() -> dict[str, str]:
    return {"rank": T.severity_rank("severity"), "path": "path", "line": "line",
            "rule_id": "rule_id", "seq": "cast(analyzer_ord AS bigint) * 1099511627776L + seq",
            "fingerprint": "coalesce(fingerprint, '')"}


def _listed(rows: DataFrame, section: int, text: str, **place: str) -> DataFrame:
    """Fragments of a list: a comma before each but the first of its repo.

    Which is the first is told by places alone, one row per repo after a partial minimum; ``place`` has to
    tell all rows of a repo apart. No text is grouped or compared.
    """
    fields = {**_EMPTY, **place}
    order = struct(**{k: fields[k] for k in PLACE[2:]})
    first = rows.groupBy("repo").agg(F.min(F.expr(order)).alias("first_place"))
    comma = f"CASE WHEN {order} = first_place THEN '' ELSE ',' END"
    return _fragment(rows.join(first, "repo"), section, f"concat({comma}, {text})", **place)


def _told_apart(notes: DataFrame, *columns: str) -> DataFrame:
    """Notes with a number among those that are equal."""
    counted = notes.groupBy("repo", *columns, "note").agg(F.count("*").alias("n"))
    return counted.select("repo", *columns, "note", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*PLACE, "text")


def _counts(enriched: DataFrame, repos: DataFrame) -> DataFrame:
    """Findings by severity and by rule beside each repo, from one small table of counts."""
    small = enriched.groupBy("repo", "severity", "rule_id").agg(F.count("*").alias("n"))
    counts = small.groupBy("repo").agg(
        *[F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in SEVERITIES],
        F.sum("n").alias("n_findings"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_id", "n")))).alias("by_rule"))
    return repos.join(counts, "repo", "left").na.fill(0)


def finding_json(text: str = "evidence", redactions: tuple[Redaction, ...] = REDACTIONS) -> str:
    return (
        "named_struct('rule_id', rule_id, 'rule_title', rule_title, 'severity', severity,"
        " 'category', category, 'analyzer', analyzer, 'path', path, 'line', line,"
        f" 'message', message, 'evidence', {T.redact(text, redactions)}, 'recommendation', recommendation,"
        " 'confidence', confidence, 'fingerprint', fingerprint, 'source_refs', source_refs)"
    )


def finding_lines(enriched: DataFrame, redactions: tuple[Redaction, ...] = REDACTIONS) -> DataFrame:
    """Findings as JSON lines, evidence masked: the form other jobs read."""
    return enriched.selectExpr("repo", f"to_json({finding_json('evidence', redactions)}) AS json")


T_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def export_json(enriched: DataFrame, summary: DataFrame, catalog: DataFrame,
                options: ScanOptions = ScanOptions(), notes: DataFrame | None = None,
                skipped: DataFrame | None = None, generated_at: str = "current_timestamp()",
                languages: DataFrame | None = None, reviewed: bool = False) -> DataFrame:
    """One JSON document per repo. ``summary`` has a row per repo (``metrics.scan_summary``).

    ``languages`` is ``metrics.files_by_language``; ``reviewed`` says that an external review took part.
    """
    counted = _counts(enriched, summary)
    per_severity = "map_filter(map(" + ", ".join(
        f"{lit(s)}, n_{s}" for s in SEVERITIES) + "), (k, v) -> v > 0)"
    if languages is None:
        counted = counted.withColumn("files_by_language", F.expr("cast(map() AS map<string,bigint>)"))
    else:
        counted = counted.join(languages, "repo", "left")

    def either(value: object) -> str:
        return "cast(NULL AS string)" if value is None else lit(value) if isinstance(value, str) else str(value)
    # Without its last brace the object stays open for the lists that follow.
    body = (
        "to_json(named_struct("
        f"'tool', named_struct('name', {lit(TOOL)}, 'version', {lit(VERSION)}),"
        " 'repository', repo,"
        f" 'generated_at', date_format({generated_at}, {lit(T_ISO)}),"
        " 'summary', named_struct('repo_path', repo, 'files_scanned', files_scanned,"
        " 'total_loc_scanned', total_loc, 'findings', n_findings,"
        f" 'snippets_sent', least(snippets, {options.max_snippets}), 'skipped_files', skipped_files,"
        f" 'semantic_enabled', {str(reviewed).lower()}, 'findings_by_severity', {per_severity}),"
        " 'config_summary', named_struct("
        f"'languages_include', {strings(options.languages_include)},"
        f" 'languages_exclude', {strings(options.languages_exclude)},"
        f" 'max_file_bytes', {options.max_file_bytes}, 'max_files', {either(options.max_files)},"
        f" 'max_snippets', {options.max_snippets},"
        f" 'max_snippets_per_file', {options.max_snippets_per_file},"
        f" 'semantic_provider', {lit(options.model)},"
        f" 'semantic_min_confidence', {options.min_confidence}D,"
        f" 'redact_before_llm', {str(options.redact).lower()},"
        f" 'report_formats', {strings(options.report_formats)},"
        f" 'fail_on_severity', {either(options.fail_on_severity)}),"
        f" 'metrics', named_struct('findings_by_severity', {per_severity},"
        " 'findings_by_rule', coalesce(by_rule, cast(map() AS map<string,bigint>)),"
        " 'files_by_language', coalesce(files_by_language, cast(map() AS map<string,bigint>)),"
        " 'total_loc', total_loc)), map('ignoreNullFields', 'false'))"
    )
    header = let(body, lambda h: f"concat(left({h}, length({h}) - 1), ',\"findings\":[')")
    rules = catalog.select("id", F.to_json(F.struct(
        "id", "title", "severity", "category", "analysis_mode", "standards", "source_refs"))
        .alias("json")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(
            F.struct("id", "json"))), lambda r: r["json"]), ",").alias("rules"))
    footer = F.concat(F.lit('],"rules":['), rules.scalar(), F.lit("]}"))
    parts = [
        _fragment(counted, 0, header),
        _listed(enriched, 1, f"to_json({finding_json('evidence', options.redactions)})",
                **_finding_place()),
        _fragment(summary, 2, "'],\"notes\":['"),
        _fragment(summary, 4, "'],\"skipped\":['"),
        _fragment(summary, 6, "''").withColumn("text", footer),
    ]
    if notes is not None:
        parts.append(_listed(
            _told_apart(notes), 3, f"concat('\"', {_json_escape('note')}, '\"')", path="note",
            seq="cast(copy AS bigint)"))
    if skipped is not None:
        parts.append(_listed(
            _told_apart(skipped, "path"), 5, f"concat('\"', {_json_escape('note')}, '\"')",
            path="coalesce(path, '')", rule_id="note", seq="cast(copy AS bigint)"))
    return _union(*parts)


def _json_escape(text: str) -> str:
    """Body of a JSON string, by way of the object Spark writes for it."""
    return f"regexp_extract(to_json(named_struct('v', {text})), {lit('(?s)^.{6}(.*).{2}$')}, 1)"


def export_sarif(enriched: DataFrame, repos: DataFrame, catalog: DataFrame,
                 redactions: tuple[Redaction, ...] = REDACTIONS) -> DataFrame:
    """SARIF 2.1.0, one document per repo, messages masked and no evidence."""
    rule = F.to_json(F.struct(
        "id", F.col("title").alias("name"),
        F.struct(F.col("title").alias("text")).alias("shortDescription"),
        F.struct(F.col("description").alias("text")).alias("fullDescription"),
        F.struct(F.col("recommendation").alias("text")).alias("help"),
        F.struct("category", "severity", "standards").alias("properties")))
    rules = catalog.select("id", rule.alias("json")).agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("id", "json"))), lambda r: r["json"]), ",").alias("rules"))
    head = ('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0",'
            f'"runs":[{{"tool":{{"driver":{{"name":"{TOOL}","rules":[')
    result = (
        "to_json(named_struct('ruleId', rule_id,"
        f" 'level', {T.sarif_level('severity')},"
        f" 'message', named_struct('text', {T.redact('message', redactions)}),"
        " 'locations', array(named_struct('physicalLocation', named_struct("
        "'artifactLocation', named_struct('uri', path),"
        " 'region', named_struct('startLine', line)))),"
        " 'partialFingerprints', named_struct("
        "'primaryLocationLineHash', coalesce(fingerprint, '')),"
        " 'properties', named_struct('confidence', confidence, 'analyzer', analyzer,"
        " 'recommendation', recommendation)))"
    )
    header = _fragment(repos, 0, "''").withColumn(
        "text", F.concat(F.lit(head), rules.scalar(), F.lit(']}},"results":[')))
    return _union(
        header,
        _listed(enriched, 1, result, **_finding_place()),
        _fragment(repos, 2, "']}]}'"))


def finding_markdown(redactions: tuple[Redaction, ...] = REDACTIONS) -> str:
    """The section of one finding."""
    evidence = f"replace({T.redact('evidence', redactions)}, '```', {lit(chr(39) * 3)})"
    parts = (
        "'### '", "upper(severity)", "' '", "rule_id", "': '", "rule_title", _FEED, _FEED,
        "'- Location: `'", "path", "':'", "line", "'`'", _FEED,
        "'- Analyzer: `'", "analyzer", "'`'", _FEED,
        "'- Confidence: `'", "format_string('%.2f', confidence)", "'`'", _FEED,
        "'- Problem: '", "message", _FEED,
        "'- Recommendation: '", "recommendation", _FEED,
        "'- Sources: '", T.source_links("source_refs"), _FEED, _FEED,
        "'```text'", _FEED, evidence, _FEED, "'```'", _FEED)
    return f"concat({', '.join(parts)})"


def export_markdown(enriched: DataFrame, summary: DataFrame, catalog: DataFrame,
                    notes: DataFrame | None = None, skipped: DataFrame | None = None,
                    generated_at: str = "current_timestamp()",
                    redactions: tuple[Redaction, ...] = REDACTIONS,
                    max_snippets: int = ScanOptions.max_snippets) -> DataFrame:
    counted = _counts(enriched, summary)
    lines = [
        f"{lit('# ' + TITLE)}", "''", "concat('- Repository: `', repo, '`')",
        f"concat('- Generated: `', date_format({generated_at}, {lit(T_ISO)}), '`')",
        "concat('- Files scanned: `', files_scanned, '`')",
        "concat('- LOC scanned: `', total_loc, '`')",
        "concat('- Findings: `', n_findings, '`')",
        f"concat('- Snippets sent to semantic analyzer: `', least(snippets, {max_snippets}), '`')", "''",
    ]
    totals = ["'## Summary'", "''"]
    totals += [f"concat('- {s.title()}: `', n_{s}, '`')" for s in SEVERITIES]
    totals += ["''", "'## Findings'", "''"]
    none = "CASE WHEN n_findings = 0 THEN 'No findings were detected by the enabled analyzers.' END"
    rule = (
        "concat('### ', id, ': ', title, {f}, {f}, '- Severity: `', severity, '`', {f},"
        " '- Analyzer: `', analysis_mode, '`', {f}, '- Category: `', category, '`', {f},"
        " '- Standards: ', array_join(standards, ', '), {f}, '- Description: ', description, {f},"
        " '- Sources: ', {s}, {f})".format(f=_FEED, s=T.source_links("source_refs")))
    rules = catalog.selectExpr("id", f"{rule} AS md").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("id", "md"))), lambda r: r["md"]), "\n").alias("rules"))
    parts = [
        _fragment(counted, 0, f"concat_ws({_FEED}, {', '.join(lines)})"),
        _fragment(counted, 3, f"concat_ws({_FEED}, {', '.join(totals)}, {none})"),
        _fragment(enriched, 4, finding_markdown(redactions), **_finding_place()),
        _fragment(summary, 5, "''").withColumn(
            "text", F.concat(F.lit("## Rule Catalog\n\n"), rules.scalar())),
    ]
    if notes is not None:
        parts.append(_fragment(notes.select("repo").distinct(), 1, lit("## Notes\n")))
        parts.append(_fragment(notes, 2, "concat('- ', note)", path="note"))
    if skipped is not None:
        parts.append(_fragment(skipped.select("repo").distinct(), 6, lit("## Skipped Files\n")))
        parts.append(_fragment(skipped, 7, "concat('- ', note)", path="coalesce(path, '')"))
    return _union(*parts)


def finding_html(redactions: tuple[Redaction, ...] = REDACTIONS) -> str:
    e = T.html_escape
    return (
        f"concat('<section><h2>', {e('upper(severity)')}, ' ', {e('rule_id')}, '</h2><p><strong>',"
        f" {e('path')}, ':', line, '</strong></p><p>', {e('message')}, '</p><pre>',"
        f" {e(T.redact('evidence', redactions))}, '</pre></section>')")


def export_html(enriched: DataFrame, summary: DataFrame,
                redactions: tuple[Redaction, ...] = REDACTIONS) -> DataFrame:
    counted = _counts(enriched, summary)
    head = (
        f"concat({lit('<!doctype html><html><head><meta charset=' + chr(34) + 'utf-8' + chr(34))},"
        f" '><title>{TITLE}</title></head><body><h1>{TITLE}</h1><p>Repository: ',"
        f" {T.html_escape('repo')}, '</p><p>Files scanned: ', files_scanned,"
        " '</p><p>LOC scanned: ', total_loc, '</p><p>Findings: ', n_findings, '</p>',"
        " CASE WHEN n_findings = 0 THEN '<p>No findings were detected.</p>' ELSE '' END)")
    return _union(
        _fragment(counted, 0, head),
        _fragment(enriched, 1, finding_html(redactions), **_finding_place()),
        _fragment(summary, 2, "'</body></html>'"))


def write_exports(reports: dict[str, DataFrame], out_dir: str,
                  formats: tuple[str, ...]) -> dict[str, str]:
    """Write each known format below ``out_dir``; returns the directory per format.

    A global sort is a range partitioning, so a large repo spreads over many tasks and its part
    files, read in name order, are the document.
    """
    paths = {}
    for name in (f.strip().lower() for f in formats):
        if name not in reports or name not in FORMATS:
            continue
        path = f"{out_dir.rstrip('/')}/{name}"
        (reports[name].orderBy(*PLACE).select("repo", "text")
         .write.mode("overwrite").partitionBy("repo").text(path))
        paths[name] = path
    return paths


def write_findings(enriched: DataFrame, path: str) -> None:
    """The primary sink: findings as parquet, one directory per repo."""
    enriched.write.mode("overwrite").partitionBy("repo").parquet(path)
