"""The same queries in DuckDB SQL, written from the row side: one row per line, joins and windows.

The library cuts files up inside arrays. These statements explode every file into rows first, so the
two agree only if both are right. Patterns and messages are shared as values; logic is not.
"""

from __future__ import annotations

from checks.corpus import CORPUS_SQL
from checks.queries import CUSTOM, FILE_LIMIT, FINDING_COLUMNS, MANY, REDACTION_TABLE
from siftspark.functions import patterns as P
from siftspark.operators import external, rules
from siftspark.options import DEFAULT_IGNORES
from siftspark.sources.catalog_values import RULES

WS = "' ' || chr(9) || chr(10) || chr(13)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def m(pattern: P.Pattern, column: str) -> str:
    return f"regexp_matches({column}, {q(pattern.re2)})"


# ------------------------------------------------------------------------------------- shared CTEs

FLAGS = """
flags AS (
  SELECT *, trim(text, {ws}) AS stripped,
         NOT {comment} AS code,
         {cols}
  FROM lines
)""".format(ws=WS, comment=m(P.COMMENT_LINE, "text"), cols=",\n         ".join(
    f"{m(p, 'text')} AS {p.name}" for p in P.LINE_PREDICATES if p is not P.COMMENT_LINE))

BLOCKS = f"""
spans AS (
  SELECT repo, path, language, line, text AS head, trim(text, {WS}) AS stripped,
         max(line) OVER w AS end_line,
         string_agg(text, chr(10)) OVER w AS text
  FROM lines
  WINDOW w AS (PARTITION BY repo, path ORDER BY line ROWS BETWEEN CURRENT ROW AND 13 FOLLOWING)
),
blocks AS (
  SELECT repo, path, language, line, end_line, text,
         CASE WHEN contains(stripped, 'catch') THEN 'catch' ELSE 'exception' END AS kind
  FROM spans
  WHERE starts_with(stripped, 'except ') OR starts_with(stripped, 'except:')
     OR starts_with(stripped, 'catch ') OR starts_with(stripped, '}} catch')
)"""

SCOPED = f"""
marks AS (
  SELECT repo, path, line, length(text) - length(ltrim(text, {WS})) AS indent
  FROM lines WHERE trim(text, {WS}) != '' AND NOT starts_with(ltrim(text, {WS}), '#')
),
counts AS (SELECT repo, path, max(line) AS n FROM lines GROUP BY ALL),
py_heads AS (
  SELECT repo, path, language, line, length(text) - length(ltrim(text, {WS})) AS indent
  FROM lines WHERE language = 'python' AND regexp_matches(text, '^\\s*except([\\s:(*]|$)')
),
py_stops AS (
  SELECT h.repo, h.path, h.language, h.line, coalesce(min(k.line) - 1, any_value(c.n)) AS stop
  FROM py_heads h JOIN counts c USING (repo, path)
  LEFT JOIN marks k ON k.repo = h.repo AND k.path = h.path AND k.line > h.line
                   AND k.indent <= h.indent
  GROUP BY ALL
),
py_ends AS (
  SELECT s.repo, s.path, s.language, s.line, max(k.line) AS end_line
  FROM py_stops s JOIN marks k ON k.repo = s.repo AND k.path = s.path
                              AND k.line BETWEEN s.line AND s.stop
  GROUP BY ALL
),
py_clauses AS (
  SELECT e.repo, e.path, e.language, 'exception' AS kind, e.line, e.end_line,
         ltrim(string_agg(l.text, chr(10) ORDER BY l.line), {WS}) AS text
  FROM py_ends e JOIN lines l ON l.repo = e.repo AND l.path = e.path
                             AND l.line BETWEEN e.line AND e.end_line
  GROUP BY ALL
),
java_heads AS (
  SELECT repo, path, language, line,
         substr(text, length(regexp_extract(text, '^(.*?)\\bcatch\\s*\\(', 1)) + 1) AS after
  FROM lines WHERE language = 'java' AND regexp_matches(text, '\\bcatch\\s*\\(')
               AND NOT {m(P.COMMENT_LINE, "text")}
),
java_rest AS (
  SELECT h.repo, h.path, h.language, h.line, h.after, any_value(c.n) AS n,
         h.after || coalesce(chr(10) || string_agg(l.text, chr(10) ORDER BY l.line), '') AS rest,
         h.after || coalesce(chr(10) || string_agg(l.text, chr(10) ORDER BY l.line)
                    FILTER (l.line <= h.line + 20), '') AS open_end
  FROM java_heads h JOIN counts c USING (repo, path)
  LEFT JOIN lines l ON l.repo = h.repo AND l.path = h.path AND l.line > h.line
  GROUP BY h.repo, h.path, h.language, h.line, h.after
),
java_pieces AS (
  SELECT repo, path, line, unnest(string_split(rest, '}}')) AS piece,
         generate_subscripts(string_split(rest, '}}'), 1) AS k,
         len(string_split(rest, '}}')) AS pieces
  FROM java_rest
),
java_depth AS (
  SELECT *, sum(length(piece) - length(replace(piece, '{{', ''))) OVER (
           PARTITION BY repo, path, line ORDER BY k) AS opens
  FROM java_pieces
),
java_stops AS (
  SELECT repo, path, line, min(k) AS stop FROM java_depth
  WHERE k < pieces AND opens > 0 AND opens - k <= 0 GROUP BY ALL
),
java_texts AS (
  SELECT r.repo, r.path, r.language, r.line,
         CASE WHEN s.stop IS NULL THEN r.open_end
              ELSE array_to_string(string_split(r.rest, '}}')[1:s.stop], '}}') || '}}' END AS text
  FROM java_rest r LEFT JOIN java_stops s USING (repo, path, line)
),
java_clauses AS (
  SELECT repo, path, language, 'catch' AS kind, line,
         line + length(text) - length(replace(text, chr(10), '')) AS end_line, text
  FROM java_texts
),
clauses AS (SELECT * FROM py_clauses UNION ALL SELECT * FROM java_clauses),
window_blocks AS (
  SELECT repo, path, language, kind, line, end_line, text FROM blocks
  WHERE NOT EXISTS (SELECT 1 FROM clauses c WHERE c.repo = blocks.repo AND c.path = blocks.path)
),
scoped_blocks AS (SELECT * FROM clauses UNION ALL SELECT * FROM window_blocks)"""


def block_flags(source: str) -> str:
    wanted = (P.LOG_CALL, P.CONSOLE_LOG, P.PROPAGATION, P.TECHNICAL_RESPONSE, P.STACK_LOGGED,
              P.LOG_AT_LEVEL, P.MESSAGE_ONLY)
    columns = ", ".join(f"{m(p, 'text')} AS {p.name}" for p in wanted)
    return f"""
block_flags AS (
  SELECT repo, path, language, line, text, {columns},
         string_split(trim(text, {WS}), chr(10)) AS parts
  FROM {source}
),
block_evidence AS (
  SELECT *, array_to_string(list_transform(parts[1:12], lambda x: rtrim(x, {WS})), chr(10))
            || CASE WHEN len(parts) > 12 THEN chr(10) || '...' ELSE '' END AS evidence
  FROM block_flags
)"""


BLOCK_WHERE = {
    rules.SWALLOWED: "NOT log_call AND NOT console_log AND NOT propagation",
    rules.CONSOLE_BLOCK: "console_log",
    rules.RESPONSE_BLOCK: "technical_response",
    rules.RETURNED_UNLOGGED: "technical_response AND NOT log_call",
    rules.MESSAGE_NO_STACK: "NOT stack_logged AND log_at_level AND message_only",
}
LINE_WHERE = {
    rules.SENSITIVE_LOGGED: "code AND log_call AND sensitive AND NOT safe_transform",
    rules.UNTRUSTED_LOGGED: "code AND log_call AND untrusted_input AND NOT sanitizer",
    rules.LOGGING_DISABLED: "code AND disable_logging",
    rules.RESPONSE_LINE: "code AND technical_response",
    rules.CONSOLE_CALL: "console_log",
}


def _emission(rule: rules.Rule, analyzer: int, step: int, pos: int, only: str | None) -> str:
    block = rule in BLOCK_WHERE
    where = BLOCK_WHERE[rule] if block else LINE_WHERE[rule]
    if only:
        where += f" AND language = '{only}'"
    source, evidence = ("block_evidence", "evidence") if block else ("flags", "stripped")
    return (
        f"SELECT repo, path, language, {q(rule.rule_id)} AS rule_id, line,"
        f" {q(rule.message)} AS message, {evidence} AS evidence, {rule.confidence}::DOUBLE AS"
        f" confidence, {q(','.join(rule.signals))} AS signals, {analyzer} AS analyzer_ord,"
        f" {step} AS step, {pos} AS pos FROM {source} WHERE {where}")


_EMITTED = (
    (rules.SENSITIVE_LOGGED, 0, 0, 0, None), (rules.UNTRUSTED_LOGGED, 0, 0, 1, None),
    (rules.LOGGING_DISABLED, 0, 0, 2, None),
    (rules.SWALLOWED, 1, 0, 0, None), (rules.CONSOLE_BLOCK, 1, 0, 1, "python"),
    (rules.RETURNED_UNLOGGED, 1, 0, 2, None), (rules.MESSAGE_NO_STACK, 1, 0, 3, None),
    (rules.RESPONSE_LINE, 2, 0, 0, None), (rules.RESPONSE_BLOCK, 2, 1, 0, None),
    (rules.RETURNED_UNLOGGED, 2, 1, 1, None), (rules.MESSAGE_NO_STACK, 2, 1, 2, None),
    (rules.CONSOLE_CALL, 3, 0, 0, "java"), (rules.CONSOLE_BLOCK, 3, 1, 0, "java"),
)
CANDIDATES = "candidates AS (\n" + "\nUNION ALL\n".join(_emission(*e) for e in _EMITTED) + "\n)"

DEDUPED = """
deduped AS (
  SELECT * FROM candidates
  QUALIFY row_number() OVER (PARTITION BY repo, path, rule_id, line, message
                             ORDER BY analyzer_ord, step, line, pos) = 1
)"""

MARKS = """
suppression AS (
  SELECT repo, path, regexp_extract(text, 'scan-disable-file\\s+([A-Z]+-\\d+)', 1) AS rule_id,
         'file' AS scope, line FROM lines
  UNION ALL
  SELECT repo, path, regexp_extract(text, 'scan-disable-next-line\\s+([A-Z]+-\\d+)', 1),
         'line', line + 1 FROM lines
),
marks_ AS (SELECT * FROM suppression WHERE rule_id != '')"""

_PRINT = ("substr(sha256(rule_id || ':' || path || ':' || (line // 5) || ':' || "
          f"substr(sha256(lower(trim(evidence, {WS}))), 1, 16)), 1, 24)")

KEPT = """
kept AS (
  SELECT d.* FROM deduped d WHERE NOT EXISTS (
    SELECT 1 FROM marks_ s WHERE s.repo = d.repo AND s.path = d.path AND s.rule_id = d.rule_id
       AND (s.scope = 'file' OR s.line = d.line))
)"""

PRINTED = f"""
printed AS (SELECT *, {_PRINT} AS fingerprint FROM kept),
processed AS (
  SELECT * FROM printed
  QUALIFY row_number() OVER (PARTITION BY repo, fingerprint
                             ORDER BY analyzer_ord, step, line, pos) = 1
)"""


def _catalog() -> str:
    rows = []
    for r in RULES:
        links = ", ".join(
            f"[{s['title']} lines {s['line_start']}-{s['line_end']}]({s['url']})"
            for s in r["source_refs"])
        rows.append("(" + ", ".join((
            q(r["id"]), q(r["title"]), q(r["severity"]), q(r["category"]), q(r["analysis_mode"]),
            q(",".join(r["languages"])), q(",".join(r["standards"])), str(len(r["source_refs"])),
            str(len(r["deterministic_signals"])), q(links), q(r["recommendation"]))) + ")")
    return ("catalog(rule_id, title, severity, category, analysis_mode, languages, standards,"
            " sources, signals_n, links, rule_recommendation) AS (VALUES " + ",\n".join(rows)
            + ")")


ENRICHED = (_catalog() + """,
enriched AS (
  SELECT p.*, c.title AS rule_title, c.severity, c.category, c.links,
         CASE c.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2
                         WHEN 'low' THEN 3 ELSE 4 END AS rank
  FROM processed p JOIN catalog c USING (rule_id)
)""")


def corpus(*parts: str) -> str:
    return "WITH " + ",\n".join((CORPUS_SQL.strip(), *(p.strip() for p in parts))) + "\n"


def chain(*more: str, blocks: str = "blocks") -> str:
    head = [FLAGS, BLOCKS]
    if blocks == "scoped_blocks":
        head.append(SCOPED)
    return corpus(*head, block_flags(blocks), CANDIDATES, *more)


ALL = (DEDUPED, MARKS, KEPT, PRINTED, ENRICHED)
COLUMNS = ", ".join(c if c != "line" else "line::BIGINT AS line" for c in FINDING_COLUMNS)

# ------------------------------------------------------------------------------------------ symbols

SYMBOLS = f"""
sym_marks AS (
  SELECT repo, path, line, length(text) - length(ltrim(text, {WS})) AS indent
  FROM lines WHERE trim(text, {WS}) != '' AND NOT starts_with(ltrim(text, {WS}), '#')
),
sym_counts AS (SELECT repo, path, max(line) AS n FROM lines GROUP BY ALL),
braces AS (
  SELECT repo, path, line, contains(text, '{{') AS opens,
         sum(length(replace(text, '}}', '')) - length(replace(text, '{{', ''))) OVER (
           PARTITION BY repo, path ORDER BY line) AS depth
  FROM lines WHERE contains(text, '{{') OR contains(text, '}}')
),
named AS (
  SELECT repo, path, language, line, text,
         length(text) - length(ltrim(text, {WS})) AS indent,
         regexp_extract(text, {q(P.PY_CLASS)}, 1) AS py_class,
         regexp_extract(text, {q(P.PY_FUNCTION)}, 1) AS py_def,
         regexp_extract(text, {q(P.JAVA_CLASS)}, 1) AS java_class,
         CASE WHEN regexp_matches(ltrim(text, {WS}), '^(if|for|while|switch|catch)') THEN ''
              ELSE regexp_extract(text, {q(P.JAVA_METHOD)}, 1) END AS java_method
  FROM lines
),
heads AS (
  SELECT repo, path, language, line, indent,
         CASE WHEN py_class != '' THEN py_class WHEN py_def != '' THEN py_def
              WHEN java_class != '' THEN java_class ELSE java_method END AS name,
         CASE WHEN py_class != '' THEN 'class'
              WHEN py_def != '' THEN CASE WHEN indent > 0 THEN 'method' ELSE 'function' END
              WHEN java_class != '' THEN 'class' ELSE 'method' END AS kind,
         py_class = '' AND py_def = '' AS braced
  FROM named WHERE py_class != '' OR py_def != '' OR java_class != '' OR java_method != ''
),
indent_ends AS (
  SELECT h.repo, h.path, h.line, coalesce(min(k.line) - 1, any_value(c.n)) AS end_line
  FROM heads h JOIN sym_counts c USING (repo, path)
  LEFT JOIN sym_marks k ON k.repo = h.repo AND k.path = h.path AND k.line > h.line
                       AND k.indent <= h.indent
  WHERE NOT h.braced GROUP BY ALL
),
brace_starts AS (
  SELECT h.repo, h.path, h.line,
         coalesce(max_by(b.depth, b.line) FILTER (b.line < h.line), 0) AS before,
         min(b.line) FILTER (b.line >= h.line AND b.opens) AS opened
  FROM heads h LEFT JOIN braces b ON b.repo = h.repo AND b.path = h.path
  WHERE h.braced GROUP BY ALL
),
brace_ends AS (
  SELECT s.repo, s.path, s.line,
         coalesce(min(b.line), least(s.line + 20, any_value(c.n))) AS end_line
  FROM brace_starts s JOIN sym_counts c USING (repo, path)
  LEFT JOIN braces b ON b.repo = s.repo AND b.path = s.path AND b.line >= s.opened
                    AND b.depth <= s.before
  GROUP BY s.repo, s.path, s.line
),
symbols AS (
  SELECT h.repo, h.path, h.language, h.name, h.kind, h.line AS start_line, e.end_line
  FROM heads h
  JOIN (SELECT * FROM indent_ends UNION ALL SELECT * FROM brace_ends) e USING (repo, path, line)
)"""


def around(source: str, columns: str) -> str:
    """Add the innermost symbol to rows with a line."""
    return f"""
SELECT {columns}, max_by(s.name, s.start_line) AS symbol
FROM {source} x LEFT JOIN symbols s
  ON s.repo = x.repo AND s.path = x.path AND x.line BETWEEN s.start_line AND s.end_line
GROUP BY ALL"""


def calls(pattern: P.Pattern, kind: str) -> str:
    hits = f"""hits AS (
  SELECT repo, path, language, {q(kind)} AS kind, line, trim(text, {WS}) AS text
  FROM lines WHERE {m(pattern, 'text')})"""
    return corpus(SYMBOLS, hits) + around(
        "hits", "x.repo, x.path, x.language, x.kind, x.line::BIGINT AS line, x.text")


def contexts(kind: str, where: str) -> str:
    hits = f"""spans13 AS (
  SELECT repo, path, language, line, text AS head, max(line) OVER w AS end_line,
         string_agg(text, chr(10)) OVER w AS text
  FROM lines
  WINDOW w AS (PARTITION BY repo, path ORDER BY line ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
),
hits AS (SELECT * FROM spans13 WHERE {where})"""
    return corpus(SYMBOLS, hits) + around(
        "hits", f"x.repo, x.path, x.language, {q(kind)} AS kind, x.line::BIGINT AS start_line,"
        " x.end_line::BIGINT AS end_line, x.text")


# ------------------------------------------------------------------------------------- raw file SQL

RAW = """
WITH raw AS (
  SELECT doc_id, source AS repo, text,
         CASE doc_id % 7 WHEN 0 THEN 'build/out/' WHEN 1 THEN 'app/.venv/lib/'
           WHEN 2 THEN 'legacy/' ELSE 'src/main/' END || 'd' || doc_id ||
         CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.PY'
           WHEN 3 THEN '.txt' ELSE '.java' END AS path,
         CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 2 THEN 'python' WHEN 3 THEN NULL
           ELSE 'java' END AS language,
         doc_id % 13 = 0 AS nul,
         octet_length(encode(text)) + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS length
  FROM documents
),
parts AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
         generate_subscripts(string_split(text, chr(10)), 1) AS k FROM raw
),
offsets AS (
  SELECT doc_id, octet_length(encode(x)) AS bytes,
         sum(octet_length(encode(x)) + 1) OVER (PARTITION BY doc_id ORDER BY k)
           - octet_length(encode(x)) - 1 AS start
  FROM parts
),
longest AS (
  SELECT doc_id, max(least(start + bytes, 20000) - start) AS widest
  FROM offsets WHERE start < 20000 GROUP BY ALL
),
judged AS (
  SELECT raw.*, CASE WHEN length > 30000 THEN 'size' WHEN nul THEN 'binary'
           WHEN length >= 20000 AND widest > 1000 THEN 'minified' END AS skip_reason,
         doc_id % 7 IN (0, 1, 2) OR ('d' || doc_id LIKE 'd77%' AND doc_id % 5 = 0) AS ignored
  FROM raw JOIN longest USING (doc_id)
),
known AS (SELECT * FROM judged WHERE NOT ignored AND language IS NOT NULL),
accepted AS (SELECT * FROM known WHERE skip_reason IS NULL)
"""
assert "build/**" in DEFAULT_IGNORES and "**/.venv/**" in DEFAULT_IGNORES


def limited(n: int) -> str:
    return f""",
cut AS (
  SELECT max(k) AS k, count(*) AS taken FROM (
    SELECT {{'path': path, 'repo': repo}} AS k FROM accepted ORDER BY k LIMIT {n})
),
inside AS (
  SELECT known.* FROM known, cut
  WHERE taken < {n} OR {{'path': path, 'repo': repo}} <= k
)"""


LEDGER_LIMIT = FILE_LIMIT * 4
SKIP_LEDGER = RAW + limited(LEDGER_LIMIT) + f"""
SELECT repo, path, skip_reason AS reason, path || CASE skip_reason
         WHEN 'size' THEN ': skipped because size exceeds 30000 bytes'
         WHEN 'binary' THEN ': skipped because it appears to be binary'
         ELSE ': skipped because it appears to be minified' END AS note
FROM inside WHERE skip_reason IS NOT NULL
UNION ALL
SELECT arg_min(repo, (path, repo)), NULL, 'limit',
  'File limit reached at {LEDGER_LIMIT}; remaining supported files were skipped.'
FROM known WHERE (repo, path) NOT IN (SELECT (repo, path) FROM inside) HAVING count(*) > 0"""

# --------------------------------------------------------------------------------------------- text

NOTES_TEXT = """
WITH notes AS (
  SELECT 'documents' AS origin, doc_id AS id, 0::BIGINT AS part, text FROM documents
  UNION ALL SELECT 'pages', page_id, 0, html FROM pages
  UNION ALL SELECT 'conversations', conv_id, turn, text FROM conversations
)"""
SECRETS = """,
every AS (
  SELECT * FROM notes UNION ALL
  SELECT 'customer', c_custkey, 0, CASE c_custkey % 9
    WHEN 0 THEN 'password = "hunter2-' WHEN 1 THEN 'api_key: '
    WHEN 2 THEN 'Authorization: Basic ' WHEN 3 THEN 'session-id='
    WHEN 4 THEN 'eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abcdefghijklmno '
    WHEN 5 THEN 'bearer abcdefghijklmnop.qrst '
    WHEN 6 THEN 'jdbc:postgresql://host/db?user='
    WHEN 7 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'abc' || chr(10)
                || '-----END RSA PRIVATE KEY----- '
    ELSE 'card 4111-1111 1111 1111 ' END || c_name || ', ' || c_nationkey
  FROM customer
)"""


def redact(column: str) -> str:
    for r in P.REDACTIONS:
        mark = ("\\1" + r.joint if r.keeps_name else "") + r.mark
        flags = "g" + ("s" if r.dot_all else "") + ("i" if r.ignore_case else "")
        column = f"regexp_replace({column}, {q(r.body)}, {q(mark)}, {q(flags)})"
    return column


def clip(column: str, n: int) -> str:
    return (f"CASE WHEN length({column}) <= {n} THEN {column}"
            f" ELSE substr({column}, 1, {n}) || chr(10) || '...' END")


# ----------------------------------------------------------------------------------------- snippets

HOT = "regexp_matches(text, " + q("(?i)(" + "|".join(P.HOTWORDS) + ")") + ")"


def window_rows(source: str, extra: str) -> str:
    return f"""
  SELECT x.repo, x.path, {extra}, greatest(1, x.line - 8) AS start_line,
         least(c.n, x.line + 8) AS end_line
  FROM {source} x JOIN sizes c USING (repo, path)"""


SIZES = "sizes AS (SELECT repo, path, max(line) AS n FROM lines GROUP BY ALL)"
SNIPPET_ROWS = SIZES + ",\nhot AS (SELECT repo, path, line FROM lines WHERE " + HOT + ")," + f"""
windows AS (
  {window_rows("deduped", "0 AS phase, x.analyzer_ord, x.step, x.line, x.pos,"
               " 'deterministic finding ' || x.rule_id AS reason")}
  UNION ALL
  {window_rows("hot", "1 AS phase, 0, 0, x.line, 0, 'semantic hotspot'")}
),
distinct_windows AS (
  SELECT * FROM windows
  QUALIFY row_number() OVER (PARTITION BY repo, path, start_line, end_line
                             ORDER BY phase, analyzer_ord, step, line, pos) = 1
),
bodies AS (
  SELECT w.repo, w.path, w.phase, w.analyzer_ord, w.step, w.line, w.pos, w.reason, w.start_line,
         w.end_line, string_agg(l.text, chr(10) ORDER BY l.line) AS body
  FROM distinct_windows w JOIN lines l
    ON l.repo = w.repo AND l.path = w.path AND l.line BETWEEN w.start_line AND w.end_line
  GROUP BY ALL
),
snippets AS (SELECT *, {clip("body", 5000)} AS text FROM bodies)"""
SNIPPET_COLUMNS = ("path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, text,"
                   " reason")


def snippet_hash(text: str) -> str:
    return (f"substr(sha256(path || ':' || start_line || ':' || end_line || ':' || sha256({text})),"
            " 1, 16)")


CANDIDATE_WINDOWS = SIZES + f""",
cand_windows AS (
  {window_rows("candidates", "x.language, x.rule_id, x.signals, x.analyzer_ord, x.step, x.line,"
               " x.pos, x.message")}
),
cand_first AS (
  SELECT * FROM cand_windows
  QUALIFY row_number() OVER (PARTITION BY repo, path, start_line, end_line
                             ORDER BY analyzer_ord, step, line, pos) = 1
),
cand_capped AS (
  SELECT * FROM cand_first
  QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY analyzer_ord, step, line, pos) <= 20
),
cand_bodies AS (
  SELECT w.repo, w.path, w.rule_id, w.signals, w.line, w.start_line, w.end_line,
         string_agg(l.text, chr(10) ORDER BY l.line) AS body
  FROM cand_capped w JOIN lines l
    ON l.repo = w.repo AND l.path = w.path AND l.line BETWEEN w.start_line AND w.end_line
  GROUP BY ALL
),
cand_masked AS (SELECT *, {redact("body")} AS masked FROM cand_bodies),
cand_named AS (
  SELECT x.*, max_by(s.name, s.start_line) AS around
  FROM cand_masked x LEFT JOIN symbols s
    ON s.repo = x.repo AND s.path = x.path AND x.line BETWEEN s.start_line AND s.end_line
  GROUP BY ALL
)
SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
       'candidate rules: ' || rule_id AS reason,
       CASE WHEN signals LIKE '%catch_block%' OR signals = 'console_logging'
              OR signals = 'exception_message_without_stack' THEN around END AS symbol,
       {snippet_hash("masked")} AS snippet_id, rule_id AS candidate_rule_ids, signals,
       {clip("masked", 5000)} AS text
FROM cand_named"""

# ---------------------------------------------------------------------------------- external review

RESPONSES = """
shaped AS (
  SELECT c.repo, c.path, c.language, c.doc % 10 AS k,
         regexp_extract(c.full_text, '[a-z]+', 0) AS first_word
  FROM (
    SELECT repo, path, language, regexp_extract(path, '[0-9]+', 0)::BIGINT AS doc,
           string_agg(text, chr(10) ORDER BY line) AS full_text
    FROM coded GROUP BY ALL) c
),
answers AS (
  SELECT repo, path, language, 'req-' || path AS request_id, k, first_word,
         CASE WHEN k = 1 THEN 'XXX-9' WHEN k = 9 THEN coalesce(own_rule, 'LOG-001') ELSE 'LOG-001' END AS rule_id,
         CASE WHEN k = 2 THEN 'no/such.py' ELSE path END AS said_path,
         CASE WHEN k = 3 THEN 99999 WHEN k = 9 THEN coalesce(own_line, 1) ELSE 1 END AS line,
         CASE WHEN k = 4 THEN 'Semantic rule matched.' ELSE 'odd' END AS message,
         CASE WHEN k = 5 THEN 'zzz-not-there' WHEN k = 8 THEN '' ELSE first_word END AS evidence,
         CASE WHEN k = 6 THEN 0.5 ELSE 1.5 END AS confidence
  FROM shaped LEFT JOIN (
    SELECT repo, path, rule_id AS own_rule, line AS own_line FROM deduped
    QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line, rule_id) = 1) USING (repo, path)
)"""
JUDGED = f"""
facts AS (
  SELECT repo, path, language AS file_language, max(line) AS file_lines,
         string_agg(text, chr(10) ORDER BY line) AS file_text
  FROM lines GROUP BY ALL
),
shown AS (
  SELECT a.request_id, count(*) AS holding
  FROM answers a JOIN snippets s ON s.repo = a.repo AND s.path = a.said_path
                                AND a.line BETWEEN s.start_line AND s.end_line
  GROUP BY ALL
),
verdicts AS (
  SELECT a.*, f.file_language, c.severity,
         CASE WHEN c.severity IS NULL THEN 'unknown_rule'
              WHEN f.file_lines IS NULL THEN 'path_not_scanned'
              WHEN s.holding IS NULL THEN 'no_snippet'
              WHEN a.line < 1 OR a.line > f.file_lines THEN 'line_outside_file'
              WHEN a.evidence = '' AND c.severity IN ('critical', 'high', 'medium')
                THEN 'no_evidence'
              WHEN a.evidence != '' AND NOT contains(f.file_text, a.evidence)
                THEN 'evidence_not_found'
              WHEN least(a.confidence, 1) < 0.7 THEN 'low_confidence'
              WHEN EXISTS (SELECT 1 FROM deduped d WHERE d.repo = a.repo AND d.path = a.said_path
                             AND d.rule_id = a.rule_id AND d.line = a.line) THEN 'duplicate'
              ELSE 'accepted' END AS reason
  FROM answers a
  LEFT JOIN facts f ON f.repo = a.repo AND f.path = a.said_path
  LEFT JOIN shown s ON s.request_id = a.request_id
  LEFT JOIN catalog c ON c.rule_id = a.rule_id
  WHERE a.k != 7
)"""
REVIEW = (DEDUPED, SNIPPET_ROWS, _catalog(), RESPONSES, JUDGED)
BAD_JSON = "'Semantic analysis response was not valid JSON.'"
ODD_ITEM = "'Semantic finding skipped because it was not an object.'"
RESPONSE_PARSE = chain(DEDUPED, RESPONSES) + f"""
SELECT repo, request_id, k != 7 AS valid_json, CASE WHEN k != 7 THEN 1 END::BIGINT AS item_ord,
       CASE WHEN k = 7 THEN {BAD_JSON} END AS note,
       CASE WHEN k != 7 THEN rule_id END AS rule_id, CASE WHEN k != 7 THEN said_path END AS path,
       CASE WHEN k != 7 THEN line END::BIGINT AS line,
       CASE WHEN k != 7 THEN message END AS message, CASE WHEN k != 7 THEN evidence END AS evidence,
       CASE WHEN k != 7 THEN '' END AS recommendation,
       CASE WHEN k != 7 THEN confidence END::DOUBLE AS confidence,
       CASE WHEN k != 7 THEN '' END AS language
FROM answers
UNION ALL
SELECT repo, request_id, true, 2, {ODD_ITEM}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM answers WHERE k != 7"""

_NOTE = {
    "unknown_rule": "'unknown rule_id ' || rule_id",
    "path_not_scanned": "'path was not scanned: ' || said_path",
    "no_snippet": "'path was not included in snippets: ' || said_path",
    "line_outside_file": "'line outside file range: ' || said_path || ':' || line",
    "no_evidence": "'missing evidence for ' || rule_id",
    "evidence_not_found": "'evidence not found in source: ' || said_path",
    "low_confidence": "'confidence below threshold for ' || rule_id",
    "duplicate": "'duplicates deterministic finding: ' || said_path || ':' || line",
}
REJECTIONS = "SELECT repo, request_id, 1::BIGINT AS item_ord, reason, CASE reason " + " ".join(
    f"WHEN {q(k)} THEN 'Semantic finding rejected: ' || {v}" for k, v in _NOTE.items()
) + " END AS note FROM verdicts WHERE reason != 'accepted'"

ACCEPTED = f"""
accepted AS (
  SELECT repo, said_path AS path, file_language AS language, rule_id, line, message,
         {redact("evidence")} AS evidence, least(greatest(confidence, 0), 1)::DOUBLE AS confidence
  FROM verdicts WHERE reason = 'accepted'
)"""
MERGED = f"""
both_sides AS (
  SELECT repo, path, rule_id, line, message, evidence, 'deterministic' AS analyzer,
         analyzer_ord, step, pos FROM deduped
  UNION ALL
  SELECT repo, path, rule_id, line, message, evidence, 'semantic', 1000, 0, 0 FROM accepted
),
unmarked AS (
  SELECT d.*, {_PRINT.replace('path', 'd.path').replace('rule_id', 'd.rule_id')
               .replace('line //', 'd.line //').replace('(evidence', '(d.evidence')} AS fingerprint
  FROM both_sides d WHERE NOT EXISTS (
    SELECT 1 FROM marks_ s WHERE s.repo = d.repo AND s.path = d.path AND s.rule_id = d.rule_id
       AND (s.scope = 'file' OR s.line = d.line))
),
merged AS (
  SELECT * FROM unmarked
  QUALIFY row_number() OVER (PARTITION BY repo, fingerprint
                             ORDER BY analyzer_ord, step, line, pos) = 1
)"""

# --------------------------------------------------------------------------------------- evaluation

PAIRS = """
expected AS (
  SELECT path AS c, rule_id, line FROM deduped WHERE line % 7 != 0
  UNION ALL SELECT path, rule_id, line + 100000 FROM deduped WHERE line % 5 = 0
),
pairs AS (
  SELECT coalesce(a.c, e.c) AS c, coalesce(a.rule_id, e.rule_id) AS rule_id,
         coalesce(a.line, e.line) AS line, (a.c IS NOT NULL)::INT AS reported,
         (e.c IS NOT NULL)::INT AS wanted
  FROM (SELECT DISTINCT path AS c, rule_id, line FROM deduped) a
  FULL JOIN (SELECT DISTINCT * FROM expected) e
    ON a.c = e.c AND a.rule_id = e.rule_id AND a.line = e.line
)"""


def ratios(key: str) -> str:
    group = f"{key}," if key else ""
    return f"""
totals AS (
  SELECT {group} sum(reported)::BIGINT AS actual_total, sum(wanted)::BIGINT AS expected_total,
         sum(reported * wanted)::BIGINT AS matched_total
  FROM pairs {"GROUP BY " + key if key else ""}
),
shares AS (
  SELECT *, CASE WHEN actual_total > 0 THEN matched_total / actual_total ELSE 1 END AS p,
         CASE WHEN expected_total > 0 THEN matched_total / expected_total ELSE 1 END AS r
  FROM totals
)
SELECT {group} actual_total, expected_total, matched_total, round(p, 4) AS precision,
       round(r, 4) AS recall,
       round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1,
       round((actual_total - matched_total) / greatest(actual_total, 1), 4) AS false_positive_rate,
       round((expected_total - matched_total) / greatest(expected_total, 1), 4)
         AS false_negative_rate,
       round(1.0::DOUBLE, 4) AS evidence_validity"""


EVALUATE = ratios("") + """,
       round(r, 4) AS line_accuracy,
       (SELECT round(sum(hit * wanted) / sum(wanted), 4) FROM (
          SELECT rule_id, max(reported * wanted) AS hit, max(wanted) AS wanted FROM pairs
          GROUP BY 1)) AS rule_coverage,
       round(actual_total / greatest((SELECT count(*) FROM lines) / 1000.0::DOUBLE, 0.001), 2)
         AS findings_per_kloc
FROM shares"""

HTML = ("replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),"
        " '\"', '&quot;'), '''', '&#x27;')")
HTML_SECTION = (
    "'<section><h2>' || " + HTML.format("upper(severity)") + " || ' ' || " + HTML.format("rule_id")
    + " || '</h2><p><strong>' || " + HTML.format("path") + " || ':' || line || '</strong></p><p>' || "
    + HTML.format("message") + " || '</p><pre>' || " + HTML.format(redact("evidence"))
    + " || '</pre></section>'")


def findings_of(blocks: str) -> str:
    return chain(*ALL, blocks=blocks) + (
        "SELECT repo, path, line::BIGINT AS line, rule_id, rule_title, severity, category, message,"
        " evidence, confidence, fingerprint FROM enriched")


def hits(where: str) -> str:
    return chain() + f"SELECT {COLUMNS} FROM candidates WHERE {where}"


# Paths of derived files the minified test drops, by bytes before each line.
_MINIFIED = """
  SELECT path FROM (
    SELECT path, octet_length(encode(text)) AS bytes,
           sum(octet_length(encode(text)) + 1) OVER (PARTITION BY repo, path ORDER BY line)
             - octet_length(encode(text)) - 1 AS start,
           sum(octet_length(encode(text)) + 1) OVER (PARTITION BY repo, path) - 1 AS total
    FROM coded)
  WHERE total >= 20000 AND start < 20000 AND least(start + bytes, 20000) - start > 1000"""


LETTERS = f"""
pairs AS (
  SELECT id, chr((97 + id // 26)::INT) || chr((97 + id % 26)::INT) AS pair
  FROM (SELECT unnest(range({MANY})) AS id)
),
lettered AS (
  SELECT repo, path, 'CUS-' || id AS rule_id, line, 'log call with ' || pair AS message
  FROM flags JOIN pairs ON contains(lower(text), pair)
  WHERE code AND log_call AND regexp_matches(text, '(?i)' || pair || '[aeiou]')
    AND NOT regexp_matches(text, '(?i)escape')
)"""

OWN = f"""
own AS (
  SELECT repo, path, 'OWN-1' AS rule_id, line, 'prints' AS message, text AS evidence
  FROM lines WHERE contains(text, 'print')
  UNION ALL
  SELECT repo, path, 'OWN-2', line, 'prints where it catches', 'catch'
  FROM blocks WHERE kind = 'catch' AND contains(text, 'print')
),
joint AS (
  SELECT repo, path, rule_id, line, message, evidence, analyzer_ord, step, pos FROM deduped
  UNION ALL SELECT *, 100, 0, 0 FROM own
),
unmarked AS (
  SELECT d.* FROM joint d WHERE NOT EXISTS (
    SELECT 1 FROM marks_ s WHERE s.repo = d.repo AND s.path = d.path AND s.rule_id = d.rule_id
       AND (s.scope = 'file' OR s.line = d.line))
),
single AS (
  SELECT *, {_PRINT} AS fingerprint FROM unmarked
  QUALIFY row_number() OVER (PARTITION BY repo, fingerprint
                             ORDER BY analyzer_ord, step, line, pos, message) = 1
)"""


def redact_custom(column: str) -> str:
    for _, body, mark, _ in REDACTION_TABLE:
        column = f"regexp_replace({column}, {q(body)}, {q(mark)}, 'gi')"
    return column


NOTES = ("WITH raw_notes AS (" + RAW + """
  SELECT repo, 'scan' AS stage, path, path || CASE skip_reason
           WHEN 'size' THEN ': skipped because size exceeds 30000 bytes'
           WHEN 'binary' THEN ': skipped because it appears to be binary'
           ELSE ': skipped because it appears to be minified' END AS note
  FROM known WHERE skip_reason IS NOT NULL
  UNION ALL
  SELECT repo, 'scan', NULL, 'No supported files were found.' FROM raw
  GROUP BY repo HAVING repo NOT IN (SELECT repo FROM accepted)
),
""" + chain(*REVIEW, SCOPED).removeprefix("WITH ") + """
SELECT * FROM raw_notes
UNION ALL
SELECT DISTINCT repo, 'scan', path, path || ': skipped because it appears to be minified'
FROM coded WHERE path IN (""" + _MINIFIED + """)
UNION ALL
SELECT DISTINCT repo, 'fallback', path, path || ': no exact block was found; line windows used.'
FROM window_blocks WHERE path NOT IN (""" + _MINIFIED + f""")
UNION ALL
SELECT repo, 'review', NULL, {BAD_JSON} FROM answers WHERE k = 7
UNION ALL
SELECT repo, 'review', NULL, {ODD_ITEM} FROM answers WHERE k != 7
UNION ALL
SELECT repo, 'review', said_path, CASE reason """ + " ".join(
    f"WHEN {q(k)} THEN 'Semantic finding rejected: ' || {v}" for k, v in _NOTE.items()
) + " END FROM verdicts WHERE reason != 'accepted'")

STREAMED = chain(*ALL, blocks="scoped_blocks") + (
    "SELECT repo, path, rule_id, line::BIGINT AS line, message, evidence, confidence, fingerprint"
    " FROM processed WHERE path NOT IN (" + _MINIFIED + ")")


def oracle_sql() -> dict[str, str]:
    from checks.report_sql import report_sql

    custom = (f"SELECT repo, path, {q(CUSTOM.rule_id)} AS rule_id, line::BIGINT AS line,"
              f" {q(CUSTOM.message)} AS message, stripped AS evidence, 0.5::DOUBLE AS confidence,"
              " 'bare_message' AS signals FROM flags"
              " WHERE code AND log_call AND message_only AND NOT sensitive")
    span = ("repo, path, language, kind, line::BIGINT AS start_line, end_line::BIGINT AS end_line,"
            " text")
    return report_sql() | {
        "corpus_scan": RAW + "SELECT repo, path, language, sha256(text) AS file_hash,"
                             " length(text) AS chars FROM accepted",
        "directory_scan": corpus() + (
            "SELECT 'tree' AS repo, repo || '/' || replace(path, 'svc/', 'svc/' || length(full_text) % 5 || '/')"
            " AS path, language, sha256(full_text) AS file_hash FROM (SELECT repo, path, language,"
            " string_agg(text, chr(10) ORDER BY line) AS full_text FROM coded GROUP BY ALL)"
            " WHERE path NOT IN (" + _MINIFIED + ")"),
        "language_filter": RAW + "SELECT repo, path, language FROM raw WHERE language = 'python'",
        "language_custom": RAW + "SELECT repo, path, CASE doc_id % 5 WHEN 3 THEN 'text' ELSE"
                                 " 'python' END AS language FROM raw WHERE doc_id % 5 IN (0, 2, 3)",
        "ignore_filter": RAW + "SELECT repo, path FROM judged WHERE NOT ignored",
        "file_quality": RAW + "SELECT repo, path, length, skip_reason FROM judged",
        "content_hash": "SELECT doc_id, sha256(text) AS file_hash FROM documents",
        "skip_ledger": SKIP_LEDGER,
        "file_limit": RAW + limited(FILE_LIMIT)
        + "SELECT repo, path, language FROM inside WHERE skip_reason IS NULL",
        "rule_catalog": chain(*ALL) + (
            "SELECT rule_id, title, c.severity, c.category, analysis_mode, languages, standards,"
            " sources::BIGINT AS sources, signals_n::BIGINT AS signals, count(e.path) AS findings"
            " FROM catalog c LEFT JOIN enriched e USING (rule_id) GROUP BY ALL"),
        "line_explode": corpus() + "SELECT repo, path, language, line::BIGINT AS line, text"
                                   " FROM lines",
        "predicate_flags": corpus(FLAGS) + (
            "SELECT repo, path, language, line::BIGINT AS line, NOT code AS comment_line, "
            + ", ".join(p.name for p in P.LINE_PREDICATES if p is not P.COMMENT_LINE)
            + " FROM flags"),
        "symbols": corpus(SYMBOLS) + "SELECT repo, path, language, name, kind,"
        " start_line::BIGINT AS start_line, end_line::BIGINT AS end_line FROM symbols",
        "imports": corpus() + f"SELECT repo, path, language, line::BIGINT AS line,"
        f" trim(text, {WS}) AS text FROM lines WHERE {m(P.IMPORT, 'text')}",
        "logger_calls": calls(P.LOG_CALL, "logger"),
        "console_calls": calls(P.CONSOLE_LOG, "console"),
        "symbol_for_line": calls(P.TECHNICAL_RESPONSE, "response"),
        "exception_blocks": corpus(SYMBOLS, BLOCKS) + around(
            "blocks", "x.repo, x.path, x.language, x.kind, x.line::BIGINT AS start_line,"
            " x.end_line::BIGINT AS end_line, x.text"),
        "exception_blocks_scoped": corpus(BLOCKS, SCOPED) + f"SELECT {span} FROM scoped_blocks",
        "api_handlers": contexts("api_handler", f"{m(P.API_HANDLER, 'head')} AND NOT"
                                                f" {m(P.GLOBAL_HANDLER, 'head')}"),
        "global_handlers": contexts("global_exception_handler", m(P.GLOBAL_HANDLER, "head")),
        "rule_log003": hits("rule_id = 'LOG-003'"),
        "rule_log004": hits("rule_id = 'LOG-004'"),
        "rule_log007": hits("rule_id = 'LOG-007'"),
        "rule_err002_line": hits("rule_id = 'ERR-002' AND step = 0"),
        "rule_log005_line": hits("rule_id = 'LOG-005' AND signals = 'console_logging'"),
        "rule_err003": hits("rule_id = 'ERR-003'"),
        "rule_log005_block": hits("rule_id = 'LOG-005' AND signals != 'console_logging'"),
        "rule_err002_block": hits("rule_id = 'ERR-002' AND step = 1"),
        "rule_err001": hits("rule_id = 'ERR-001'"),
        "all_candidates": chain() + f"SELECT {COLUMNS}, analyzer_ord::BIGINT AS analyzer_ord"
                                    " FROM candidates",
        "custom_rule": corpus(FLAGS) + custom,
        "custom_rules_many": chain(DEDUPED, LETTERS) + (
            "SELECT repo, path, rule_id, line::BIGINT AS line, message, confidence FROM deduped"
            " UNION ALL SELECT repo, path, rule_id, line, message, 0.4 FROM lettered"),
        "custom_analyzer": chain(DEDUPED, MARKS, OWN) + (
            "SELECT repo, path, rule_id, line::BIGINT AS line, message, fingerprint FROM single"),
        "dedupe_candidates": chain(DEDUPED) + f"SELECT {COLUMNS}, analyzer_ord::BIGINT AS"
                                              " analyzer_ord FROM deduped",
        "raw_findings": chain(DEDUPED) + f"SELECT {COLUMNS}, analyzer_ord::BIGINT AS"
                                         " analyzer_ord FROM deduped",
        "suppressions": corpus(MARKS) + "SELECT repo, path, rule_id, scope, line::BIGINT AS line"
                                        " FROM marks_",
        "suppress": chain(DEDUPED, MARKS, KEPT) + f"SELECT {COLUMNS} FROM kept",
        "fingerprint": chain(DEDUPED) + f"SELECT path, rule_id, line::BIGINT AS line, message,"
                                        f" {_PRINT} AS fingerprint FROM deduped",
        "fingerprint_dedupe": chain(DEDUPED) + (
            f"SELECT path, rule_id, line::BIGINT AS line, message, {_PRINT} AS fingerprint"
            " FROM deduped QUALIFY row_number() OVER (PARTITION BY repo, fingerprint"
            " ORDER BY analyzer_ord, step, line, pos) = 1"),
        "findings_enriched": findings_of("blocks"),
        "findings_scoped": findings_of("scoped_blocks"),
        "severity_rank": chain(*ALL) + (
            "SELECT path, line::BIGINT AS line, rule_id, fingerprint, rank::BIGINT AS"
            " severity_rank, CASE WHEN rank <= 1 THEN 'error' WHEN rank = 2 THEN 'warning'"
            " ELSE 'note' END AS sarif_level FROM enriched"),
        "ordered_findings": chain(*ALL) + (
            "SELECT repo, path, line::BIGINT AS line, rule_id, severity, message, fingerprint"
            " FROM enriched ORDER BY rank, path, line, rule_id"),
        "notes": NOTES,
        "redact_custom": NOTES_TEXT + SECRETS + "SELECT origin, id, part, "
        + redact_custom("text") + " AS redacted FROM every",
        "redact_text": NOTES_TEXT + SECRETS + "SELECT origin, id, part, " + redact("text")
        + " AS redacted FROM every",
        "clip_text": NOTES_TEXT + f""",
cut AS (SELECT *, string_split(trim(text, {WS}), chr(10)) AS parts FROM notes)
SELECT origin, id, part, {clip("text", 300)} AS clipped,
       array_to_string(list_transform(parts[1:12], lambda x: rtrim(x, {WS})), chr(10))
         || CASE WHEN len(parts) > 12 THEN chr(10) || '...' ELSE '' END AS shortened
FROM cut""",
        "hotspots": corpus(SIZES, f"hot AS (SELECT repo, path, line FROM lines WHERE {HOT})",
                           f"hot_windows AS ({window_rows('hot', 'x.line')})") + f"""
SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
       {clip("body", 5000)} AS text
FROM (SELECT w.path, w.line, w.start_line, w.end_line,
             string_agg(l.text, chr(10) ORDER BY l.line) AS body
      FROM hot_windows w JOIN lines l ON l.repo = w.repo AND l.path = w.path
                                     AND l.line BETWEEN w.start_line AND w.end_line
      GROUP BY ALL)""",
        "hotspots_scoped": corpus(SYMBOLS, BLOCKS, SCOPED) + f"""
, declared AS (
  SELECT s.repo, s.path, s.start_line, s.end_line, s.name, s.kind,
         ltrim(string_agg(l.text, chr(10) ORDER BY l.line), {WS}) AS text
  FROM symbols s JOIN lines l ON l.repo = s.repo AND l.path = s.path
                             AND l.line BETWEEN s.start_line AND s.end_line
  WHERE s.language = 'python' OR s.kind = 'method' GROUP BY ALL
),
spots AS (
  SELECT path, start_line, end_line, text FROM declared
  UNION ALL SELECT path, line, end_line, text FROM scoped_blocks
)
SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line,
       {clip("text", 5000)} AS text FROM spots WHERE {HOT}""",
        "snippet_windows": chain(DEDUPED, SNIPPET_ROWS) + f"SELECT {SNIPPET_COLUMNS} FROM snippets",
        "first_snippets": chain(DEDUPED, SNIPPET_ROWS) + (
            f"SELECT {SNIPPET_COLUMNS} FROM snippets"
            " ORDER BY phase, snippets.path, repo, analyzer_ord, step, line, pos LIMIT 40"),
        "snippets_per_file": chain(SYMBOLS, CANDIDATE_WINDOWS),
        "snippet_ids": chain(DEDUPED, SNIPPET_ROWS) + (
            "SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, "
            + snippet_hash("text") + " AS snippet_id, " + redact("text") + " AS text FROM snippets"),
        "cache_misses": chain(DEDUPED, RESPONSES) + (
            "SELECT request_id, path FROM answers WHERE k = 7 OR path NOT LIKE '%.py'"),
        "response_parse": RESPONSE_PARSE,
        "validate_external": chain(*REVIEW, ACCEPTED) + (
            "SELECT repo, path, language, rule_id, line::BIGINT AS line, message, evidence,"
            " confidence FROM accepted"),
        "rejections": chain(*REVIEW) + REJECTIONS,
        "merge_findings": chain(*REVIEW, ACCEPTED, MARKS, MERGED) + (
            "SELECT repo, path, rule_id, line::BIGINT AS line, analyzer, severity, fingerprint"
            " FROM merged JOIN catalog USING (rule_id)"),
        "gate_after_review": chain(*REVIEW, ACCEPTED, MARKS, MERGED) + (
            "SELECT repo, max(CASE WHEN f.severity IN ('critical', 'high', 'medium') THEN 1 ELSE 0 END)::BIGINT AS exit_code"
            " FROM (SELECT DISTINCT repo FROM lines) LEFT JOIN"
            " (SELECT repo, severity FROM merged JOIN catalog USING (rule_id)) f USING (repo) GROUP BY 1"),
        "by_severity": chain(*ALL) + "SELECT severity, count(*) AS findings FROM enriched GROUP BY 1",
        "by_severity_filled": chain(*ALL) + (
            "SELECT repo, severity, count(e.path) AS findings FROM"
            " (SELECT DISTINCT repo FROM lines) r CROSS JOIN (VALUES ('critical'), ('high'),"
            " ('medium'), ('low'), ('info')) v(severity) LEFT JOIN enriched e"
            " USING (repo, severity) GROUP BY ALL"),
        "by_rule": chain(*ALL) + "SELECT rule_id, count(*) AS findings FROM enriched GROUP BY 1",
        "by_language": corpus() + "SELECT language, count(DISTINCT doc_id) AS files FROM numbered"
                                  " GROUP BY 1",
        "total_loc": NOTES_TEXT + (
            "SELECT sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10)))"
            " - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END)::BIGINT AS total_loc"
            " FROM notes"),
        "scan_summary": chain(DEDUPED, MARKS, KEPT, PRINTED, SNIPPET_ROWS) + """
SELECT repo, files AS files_scanned, loc AS total_loc, coalesce(f.n, 0) AS findings,
       coalesce(s.n, 0) AS snippets, 0::BIGINT AS skipped_files
FROM (SELECT repo, count(DISTINCT doc_id) AS files FROM numbered GROUP BY 1)
JOIN (SELECT repo, count(*) AS loc FROM lines GROUP BY 1) USING (repo)
LEFT JOIN (SELECT repo, count(*) AS n FROM processed GROUP BY 1) f USING (repo)
LEFT JOIN (SELECT repo, count(*) AS n FROM snippets GROUP BY 1) s USING (repo)""",
        "severity_gate": chain(*ALL) + (
            "SELECT repo, max(CASE WHEN e.rank <= 1 THEN 1 ELSE 0 END)::BIGINT AS exit_code FROM"
            " (SELECT DISTINCT repo FROM coded) LEFT JOIN enriched e USING (repo) GROUP BY 1"),
        "evaluate": chain(DEDUPED, PAIRS) + "," + EVALUATE,
        "evaluate_by_rule": chain(DEDUPED, PAIRS) + "," + ratios("rule_id").replace(
            "round(1.0::DOUBLE, 4)", "CASE WHEN actual_total > 0 THEN 1.0::DOUBLE ELSE 1 END")
        + " FROM shares",
        "evidence_check": chain(DEDUPED) + (
            "SELECT path, rule_id, line::BIGINT AS line, message,"
            " len(list_filter(string_split(evidence || CASE WHEN line % 5 = 0 THEN chr(10)"
            " || 'nowhere in ' || path ELSE '' END, chr(10)), lambda l: l <> '...'"
            " AND NOT contains(full_text, l))) = 0 AS evidence_valid"
            " FROM deduped JOIN (SELECT repo, path, string_agg(text, chr(10) ORDER BY line)"
            " AS full_text FROM lines GROUP BY ALL) USING (repo, path)"),
        "source_links": chain(*ALL) + (
            "SELECT path, line::BIGINT AS line, rule_id, fingerprint, links FROM enriched"),
        "export_html_sections": chain(*ALL) + (
            "SELECT path, line::BIGINT AS line, rule_id, fingerprint, " + HTML_SECTION
            + " AS html FROM enriched"),
        "scan_stream": STREAMED,
        # What arrives a second time is not new; counts see it twice.
        "stream_unseen": STREAMED,
        "stream_counts": f"SELECT repo, rule_id, 2 * count(*) AS findings FROM ({STREAMED})"
                         " GROUP BY repo, rule_id",
        "unscanned": "SELECT DISTINCT sha256(text) AS file_hash, length(text) AS chars"
                     " FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text)"
                     " FROM documents JOIN labels USING (doc_id))",
    }
