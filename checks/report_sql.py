"""Whole reports in DuckDB SQL: every fragment with its place, texts put together by hand.

What depends on the catalog alone (rule lists, references) is written here once, by Python's JSON writer.
"""

from __future__ import annotations

import json

from checks.oracle import (
    ALL, DEDUPED, HOT, HTML_SECTION, SNIPPET_ROWS, SYMBOLS, WS, chain, q, redact, snippet_hash, window_rows,
)
from siftspark.operators import exports, external
from siftspark.options import ScanOptions
from siftspark.sources.catalog_values import RULES

OPTIONS = ScanOptions()
TEXT_OF_TIME = "2024-01-01T00:00:00.000000Z"
SEVERITIES = ("critical", "high", "medium", "low", "info")


def compact(value: object) -> str:
    """JSON without blanks and without fields that are null."""
    def bare(x: object) -> object:
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if v is not None}
        return [bare(v) for v in x] if isinstance(x, list) else x
    return json.dumps(bare(value), ensure_ascii=False, separators=(",", ":"))


def _refs(rule: dict) -> list[dict]:
    return [{k: ref.get(k) for k in ("title", "url", "line_start", "line_end", "note")} for ref in rule["source_refs"]]


BY_ID = sorted(RULES, key=lambda r: r["id"])
JSON_RULES = ",".join(compact({
    **{k: r[k] for k in ("id", "title", "severity", "category", "analysis_mode", "standards")},
    "source_refs": _refs(r)}) for r in BY_ID)
SARIF_RULES = ",".join(compact({
    "id": r["id"], "name": r["title"], "shortDescription": {"text": r["title"]},
    "fullDescription": {"text": r["description"]}, "help": {"text": r["recommendation"]},
    "properties": {k: r[k] for k in ("category", "severity", "standards")}}) for r in BY_ID)
FACTS = "facts(rule_id, refs, recommendation) AS (VALUES " + ", ".join(
    f"({q(r['id'])}, {q(compact(_refs(r)))}, {q(r['recommendation'])})" for r in RULES) + ")"
REPORTED = f"""
{FACTS},
sizes AS (SELECT repo, path, max(line) AS n FROM lines GROUP BY ALL),
declared AS (
  SELECT s.repo, s.path, s.start_line, s.end_line,
         ltrim(string_agg(l.text, chr(10) ORDER BY l.line), {WS}) AS text
  FROM symbols s JOIN lines l ON l.repo = s.repo AND l.path = s.path
                             AND l.line BETWEEN s.start_line AND s.end_line
  WHERE s.language = 'python' OR s.kind = 'method' GROUP BY s.repo, s.path, s.start_line, s.end_line, s.name
),
shown AS (
  SELECT DISTINCT repo, path, start_line, end_line FROM (
    SELECT repo, path, start_line, end_line FROM ({window_rows("deduped", "x.line")})
    UNION ALL SELECT repo, path, start_line, end_line FROM declared WHERE {HOT}
    UNION ALL SELECT repo, path, line, end_line FROM scoped_blocks WHERE {HOT})
),
found AS (
  SELECT repo, rank, path, line, e.rule_id, rule_title, severity, category, links, message, evidence, confidence,
         fingerprint, refs, recommendation,
         analyzer_ord * 1099511627776 + (analyzer_ord * 2 + step) * 1099511627776 + line * 64 + CASE analyzer_ord
           WHEN 0 THEN pos WHEN 1 THEN 3 + pos WHEN 2 THEN 7 + step + pos ELSE 11 + step END AS seq
  FROM enriched e JOIN facts USING (rule_id)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY rank, path, line, rule_id, seq, fingerprint) AS place FROM found
),
severities AS (SELECT repo, severity, count(*) AS n, min(rank) AS rank FROM found GROUP BY ALL),
rules_ AS (SELECT repo, rule_id, count(*) AS n FROM found GROUP BY ALL),
langs AS (SELECT repo, language, count(DISTINCT doc_id) AS n FROM numbered GROUP BY ALL),
totals AS (
  SELECT repo, files, loc, coalesce(f.n, 0) AS n_findings, least({OPTIONS.max_snippets}, coalesce(s.n, 0)) AS sent,
         {", ".join(f"coalesce(f.n_{s}, 0) AS n_{s}" for s in SEVERITIES)},
         coalesce(by_severity, '') AS by_severity, coalesce(by_rule, '') AS by_rule, by_language
  FROM (SELECT repo, count(DISTINCT doc_id) AS files FROM numbered GROUP BY 1)
  JOIN (SELECT repo, count(*) AS loc FROM lines GROUP BY 1) USING (repo)
  JOIN (SELECT repo, string_agg('"' || language || '":' || n, ',' ORDER BY language) AS by_language FROM langs GROUP BY 1) USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS n, {", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in SEVERITIES)}
             FROM found GROUP BY 1) f USING (repo)
  LEFT JOIN (SELECT repo, string_agg('"' || severity || '":' || n, ',' ORDER BY rank) AS by_severity FROM severities GROUP BY 1) USING (repo)
  LEFT JOIN (SELECT repo, string_agg('"' || rule_id || '":' || n, ',' ORDER BY rule_id) AS by_rule FROM rules_ GROUP BY 1) USING (repo)
  LEFT JOIN (SELECT repo, count(*) AS n FROM shown GROUP BY 1) s USING (repo)
)"""


def j(column: str) -> str:
    return f"to_json({column})::VARCHAR"


def fragment(section: int, text: str, source: str = "totals") -> str:
    return (f"SELECT repo, {section}::BIGINT AS section, 0::BIGINT AS rank, '' AS path, 0::BIGINT AS line, '' AS rule_id,"
            f" 0::BIGINT AS seq, '' AS fingerprint, {text} AS text FROM {source}")


def listed(section: int, text: str) -> str:
    return (f"SELECT repo, {section}, rank, path, line, rule_id, seq, fingerprint, {text} FROM placed")


COMMA = "CASE WHEN place = 1 THEN '' ELSE ',' END || "


def _json() -> str:
    config = json.dumps({
        "languages_include": OPTIONS.languages_include, "languages_exclude": OPTIONS.languages_exclude,
        "max_file_bytes": OPTIONS.max_file_bytes, "max_files": None, "max_snippets": OPTIONS.max_snippets,
        "max_snippets_per_file": OPTIONS.max_snippets_per_file, "semantic_provider": OPTIONS.model,
        "semantic_min_confidence": OPTIONS.min_confidence, "redact_before_llm": True,
        "report_formats": OPTIONS.report_formats, "fail_on_severity": None}, separators=(",", ":"))
    head = " || ".join((
        q(f'{{"tool":{{"name":"{exports.TOOL}","version":"{exports.VERSION}"}},"repository":'), j("repo"),
        q(f',"generated_at":"{TEXT_OF_TIME}","summary":{{"repo_path":'), j("repo"), q(',"files_scanned":'), "files",
        q(',"total_loc_scanned":'), "loc", q(',"findings":'), "n_findings", q(',"snippets_sent":'), "sent",
        q(',"skipped_files":0,"semantic_enabled":false,"findings_by_severity":{'), "by_severity",
        q(f'}}}},"config_summary":{config},"metrics":{{"findings_by_severity":{{'), "by_severity",
        q('},"findings_by_rule":{'), "by_rule", q('},"files_by_language":{'), "by_language", q('},"total_loc":'), "loc",
        q('},"findings":[')))
    finding = COMMA + " || ".join((
        q('{"rule_id":'), j("rule_id"), q(',"rule_title":'), j("rule_title"), q(',"severity":'), j("severity"),
        q(',"category":'), j("category"), q(',"analyzer":"deterministic","path":'), j("path"), q(',"line":'), "line",
        q(',"message":'), j("message"), q(',"evidence":'), j(redact("evidence")), q(',"recommendation":'), j("recommendation"),
        q(',"confidence":'), "confidence", q(',"fingerprint":'), j("fingerprint"), q(',"source_refs":'), "refs", q("}")))
    return "\nUNION ALL ".join((
        fragment(0, head), listed(1, finding), fragment(2, q('],"notes":[')), fragment(4, q('],"skipped":[')),
        fragment(6, q(f'],"rules":[{JSON_RULES}]}}'))))


def _sarif() -> str:
    head = ('{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0",'
            f'"runs":[{{"tool":{{"driver":{{"name":"{exports.TOOL}","rules":[{SARIF_RULES}]}}}},"results":[')
    level = "CASE WHEN rank <= 1 THEN 'error' WHEN rank = 2 THEN 'warning' ELSE 'note' END"
    result = COMMA + " || ".join((
        q('{"ruleId":'), j("rule_id"), q(',"level":'), j(level), q(',"message":{"text":'), j(redact("message")),
        q('},"locations":[{"physicalLocation":{"artifactLocation":{"uri":'), j("path"), q('},"region":{"startLine":'),
        "line", q('}}}],"partialFingerprints":{"primaryLocationLineHash":'), j("fingerprint"),
        q('},"properties":{"confidence":'), "confidence", q(',"analyzer":"deterministic","recommendation":'),
        j("recommendation"), q("}}")))
    return "\nUNION ALL ".join((fragment(0, q(head)), listed(1, result), fragment(2, q("]}]}"))))


def _markdown() -> str:
    feed = "chr(10)"
    head = f" || {feed} || ".join((
        q(f"# {exports.TITLE}"), "''", "'- Repository: `' || repo || '`'", q(f"- Generated: `{TEXT_OF_TIME}`"),
        "'- Files scanned: `' || files || '`'", "'- LOC scanned: `' || loc || '`'", "'- Findings: `' || n_findings || '`'",
        "'- Snippets sent to semantic analyzer: `' || sent || '`'", "''"))
    totals = f" || {feed} || ".join((
        q("## Summary"), "''", *(f"'- {s.title()}: `' || n_{s} || '`'" for s in SEVERITIES), "''", q("## Findings"), "''"))
    totals += (f" || CASE WHEN n_findings = 0 THEN {feed} ||"
               " 'No findings were detected by the enabled analyzers.' ELSE '' END")
    finding = " || ".join((
        "'### ' || upper(severity) || ' ' || rule_id || ': ' || rule_title", f"{feed} || {feed}",
        f"'- Location: `' || path || ':' || line || '`' || {feed}", f"'- Analyzer: `deterministic`' || {feed}",
        f"'- Confidence: `' || printf('%.2f', confidence) || '`' || {feed}", f"'- Problem: ' || message || {feed}",
        f"'- Recommendation: ' || recommendation || {feed}", f"'- Sources: ' || links || {feed} || {feed}",
        f"'```text' || {feed} || replace({redact('evidence')}, '```', '''''''''') || {feed} || '```' || {feed}"))
    rules = []
    for r in BY_ID:
        links = ", ".join(f"[{s['title']} lines {s['line_start']}-{s['line_end']}]({s['url']})" for s in r["source_refs"])
        rules.append(
            f"### {r['id']}: {r['title']}\n\n- Severity: `{r['severity']}`\n- Analyzer: `{r['analysis_mode']}`\n"
            f"- Category: `{r['category']}`\n- Standards: {', '.join(r['standards'])}\n- Description: {r['description']}\n"
            f"- Sources: {links}\n")
    return "\nUNION ALL ".join((
        fragment(0, head), fragment(3, totals), listed(4, finding), fragment(5, q("## Rule Catalog\n\n" + "\n".join(rules)))))


def _html() -> str:
    title = exports.TITLE
    head = (q(f'<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><p>Repository: ')
            + " || repo || '</p><p>Files scanned: ' || files || '</p><p>LOC scanned: ' || loc || '</p><p>Findings: ' || n_findings"
            " || '</p>' || CASE WHEN n_findings = 0 THEN '<p>No findings were detected.</p>' ELSE '' END")
    return "\nUNION ALL ".join((fragment(0, head), listed(1, HTML_SECTION), fragment(2, q("</body></html>"))))


REVIEW_RULES = compact([{
    **{k: r[k] for k in ("id", "title", "severity", "description")}, "semantic_check": r["semantic_prompt"],
    **{k: r[k] for k in ("recommendation", "standards")}} for r in BY_ID if r["analysis_mode"] in ("semantic", "hybrid")])


def _bins() -> str:
    """Requests over the files of a repo, in window mode."""
    payload = " || ".join((
        q('{"snippet_id":'), j(snippet_hash("text")), q(',"path":'), j("path"), q(',"language":'), j("language"),
        q(',"start_line":'), "start_line", q(',"end_line":'), "end_line",
        q(',"symbol":null,"candidate_rule_ids":[],"deterministic_signals":[],"reason":'), j("reason"),
        q(',"text":'), j(redact("text")), q("}")))
    key = q(f"{OPTIONS.catalog_version}\n{OPTIONS.model}\n{','.join(r['id'] for r in BY_ID)}\n")
    head = q(f"{external.INSTRUCTIONS}\n\nRules:\n{REVIEW_RULES}\n\nSnippets:\n")
    return chain(DEDUPED, SNIPPET_ROWS) + f""",
ranked AS (
  SELECT repo, {payload} AS payload, row_number() OVER (
           PARTITION BY repo ORDER BY phase, path, analyzer_ord, step, line, pos) - 1 AS rank
  FROM snippets s JOIN (SELECT DISTINCT repo, path, language FROM coded) USING (repo, path)
),
bins AS (
  SELECT repo, rank // {OPTIONS.max_snippets} + 1 AS batch, count(*) AS snippets,
         '[' || string_agg(payload, ',' ORDER BY rank) || ']' AS payload
  FROM ranked GROUP BY ALL
),
requests AS (SELECT repo, sha256({key} || payload) AS request_id, batch, snippets, {head} || payload AS prompt FROM bins)"""


EXCHANGED = """
SELECT repo, batch, request_id,
       CASE WHEN request_id LIKE 'f%' THEN 'bad' ELSE 'answered' END AS state,
       CASE WHEN request_id LIKE 'a%' THEN 0 WHEN regexp_matches(request_id, '^[0-3f]') THEN 2 ELSE 1 END AS attempts,
       CASE WHEN request_id LIKE 'f%' THEN NULL WHEN request_id LIKE 'a%' THEN '{"findings":[]}'
            ELSE '{"findings":[], "of":"' || substr(request_id, 1, 8) || '"}' END AS text
FROM requests"""


def report_sql() -> dict[str, str]:
    start = chain(SYMBOLS, *ALL, REPORTED, blocks="scoped_blocks")
    return {"export_json": start + _json(), "export_sarif": start + _sarif(), "export_markdown": start + _markdown(),
            "export_html": start + _html(), "review_exchange": _bins() + EXCHANGED,
            "prompt_bins": _bins() + "SELECT repo, request_id, batch, snippets, prompt FROM requests"}
