"""From files to candidates and findings.

Candidates, their keep-first de-duplication, suppression and fingerprints all depend on one file
only, so ``raw_findings`` and ``findings`` do them inside the file's row and shuffle nothing.
``keep_first``, ``suppress`` and ``fingerprint_dedupe`` are the same steps on plain tables, for rows
that come from elsewhere; they group with a partial aggregate, so copies collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import text as T
from siftspark.functions.sql import each, each_at, keep, keep_at, let, lit, strings, struct, when
from siftspark.functions.text import Probe, has_folding_letters, shorten, split_lines, strip
from siftspark.operators import extract as X
from siftspark.operators.rules import (
    EMISSIONS, Emission, Gate, custom_groups, custom_hits, custom_literal, custom_possible, emissions, language_mask,
    rule_mask, table_width,
)
from siftspark.options import ScanOptions

ANALYZER = "deterministic"
ORDER = ("analyzer_ord", "seq")
MERGED_ORDER = (*ORDER, "request_id", "evidence")     # items of two requests may have one place
_STEP = 1 << 40      # room for the line number and the rule position below one analyzer step


def _table_literal(table: tuple[Emission, ...]) -> str:
    return "array(" + ", ".join(
        struct(bit=f"{1 << i}L", hit=str(i), base=f"{(e.analyzer_ord * 2 + e.step) * _STEP + i}L")
        for i, e in enumerate(table)) + ")"


def _emit(hit: str, evidence: str, width: int) -> str:
    """One struct per built-in rule that holds for this line or block."""
    return let(evidence, lambda ev: each(
        keep(_table_literal(EMISSIONS), lambda b: f"({hit}.mask & {b}.bit) != 0"),
        lambda b: struct(ord=f"{b}.base + {hit}.line * {width}L", hit=f"{b}.hit",
                         line=f"{hit}.line", evidence=ev)))


def _custom_array(options: ScanOptions, lines_: str, language: str, odd: str) -> str:
    """Hits on the user's rules, group by group: texts that pass the gate, rules they can break, hits of each rule."""
    width = table_width(options.custom_rules)

    def of_lines(gate: Gate) -> str:
        return keep(each_at(lines_, lambda x, i: struct(line=f"{i} + 1", text=x, low=f"lower({x})")),
                    lambda h: gate.opens(Probe(f"{h}.text", f"{h}.low", odd)))

    def of_blocks(gate: Gate) -> str:
        return keep(each(X.block_array(lines_, language, options.block_mode), lambda b: struct(
            line=f"{b}.line", text=f"{b}.text", low=f"lower({b}.text)")),
            lambda h: gate.opens(Probe(f"{h}.text", f"{h}.low", odd)))

    def hits(gate: Gate, literal: str) -> str:
        def emitted(texts: str, rules: str) -> str:
            return f"flatten({each(rules, lambda r: each(custom_hits(texts, r, odd), lambda h: struct(
                ord=f'{r}.base + {h}.line * {width}L', hit=f'{r}.hit', line=f'{h}.line',
                evidence=shorten(f'{h}.text') if gate.block else strip(f'{h}.text'))))})"

        def of(texts: str) -> str:
            joined = f"array_join({each(texts, lambda h: f'{h}.low')}, {lit(chr(10))})"
            rules = let(joined, lambda low: custom_possible(literal, low, odd, language))
            return when(f"size({texts}) > 0", let(rules, lambda rs: emitted(texts, rs)))
        none = "cast(array() AS array<struct<ord:bigint,hit:int,line:int,evidence:string>>)"
        return f"coalesce({let(of_blocks(gate) if gate.block else of_lines(gate), of)}, {none})"

    groups = custom_groups(options.custom_rules)
    return f"concat({', '.join(hits(gate, custom_literal(gate, own, _STEP)) for gate, own in groups.items())})"


def candidate_array(options: ScanOptions, text: str = "text", language: str = "language") -> str:
    """``struct<ord, hit, line, evidence>`` in emission order; ``hit`` indexes the rule table."""
    table, width = EMISSIONS, table_width(options.custom_rules)

    def mask(x: str, scopes: tuple[str, ...], odd: str, allowed: str) -> str:
        bits = let(f"lower({x})", lambda low: rule_mask(table, scopes, Probe(x, low, odd)))
        return f"({bits} & {allowed})"

    def build(lines_: str, odd: str, allowed: str) -> str:
        line_hits = keep(
            each_at(lines_, lambda x, i: struct(
                line=f"{i} + 1", text=x, mask=mask(x, ("line", "call"), odd, allowed))),
            lambda h: f"{h}.mask != 0")
        blocks = keep(
            each(X.block_array(lines_, language, options.block_mode), lambda b: struct(
                line=f"{b}.line", text=f"{b}.text",
                mask=mask(f"{b}.text", ("block",), odd, allowed))),
            lambda h: f"{h}.mask != 0")
        found = "flatten(concat({}, {}))".format(
            each(line_hits, lambda h: _emit(h, strip(f"{h}.text"), width)),
            each(blocks, lambda h: _emit(h, shorten(f"{h}.text"), width)))
        if options.custom_rules:
            found = f"concat({found}, {_custom_array(options, lines_, language, odd)})"
        return f"array_sort({found})"

    known = struct(lines=split_lines(text), odd=has_folding_letters(text),
                   allowed=language_mask(table, language))
    return let(known, lambda k: build(f"{k}.lines", f"{k}.odd", f"{k}.allowed"))


def _describe(hits: DataFrame, options: ScanOptions, *extra: str) -> DataFrame:
    """Replace the table index by the rule's own columns."""
    facts = "array(" + ", ".join(
        struct(rule_id=lit(e.rule.rule_id), message=lit(e.rule.message),
               confidence=f"{e.rule.confidence}D", signals=strings(e.rule.signals),
               analyzer_ord=str(e.analyzer_ord))
        for e in emissions(options.custom_rules)) + ")"
    fact = f"element_at({facts}, hit + 1)"
    return hits.selectExpr(
        *X.KEYS, f"{fact}.rule_id AS rule_id", "line", f"{fact}.message AS message", "evidence",
        f"{lit(ANALYZER)} AS analyzer", f"{fact}.confidence AS confidence",
        f"{fact}.signals AS signals", f"{fact}.analyzer_ord AS analyzer_ord", "ord AS seq", *extra)


def candidates(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """All rule hits in emission order, repeats included."""
    return _describe(X.rows(files, candidate_array(options)), options)


def keep_first_in_row(array: str, keys: str) -> str:
    """Elements whose key has not occurred before; both arrays run in parallel.

    Sorted by key and place, the first of each key follows another key: n log n, and no shuffle.
    """
    placed = each_at(keys, lambda k, i: struct(k=k, i=i))
    firsts = let(f"sort_array({placed})", lambda s: each(
        keep_at(s, lambda e, i: f"{i} = 0 OR {e}.k <> get({s}, {i} - 1).k"), lambda e: f"{e}.i"))
    return each(f"sort_array({firsts})", lambda i: f"get({array}, {i})")


def deduped_array(options: ScanOptions, text: str = "text", language: str = "language") -> str:
    """Candidates without repeats of (rule, line, message)."""
    groups: dict[tuple[str, str], int] = {}
    ids = ", ".join(str(groups.setdefault((e.rule.rule_id, e.rule.message), len(groups)))
                    for e in emissions(options.custom_rules))
    return let(candidate_array(options, text, language), lambda cs: keep_first_in_row(
        cs, each(cs, lambda c: f"{c}.line * {table_width(options.custom_rules)}L"
                               f" + element_at(array({ids}), {c}.hit + 1)")))


def raw_findings(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """De-duplicated hits before suppression, without fingerprints."""
    return _describe(X.rows(files, deduped_array(options)), options)


def raw_of(once: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``raw_findings`` of files whose ``hits`` hold ``deduped_array`` already."""
    return _describe(X.rows(once, "hits"), options)


def analyzed(files: DataFrame, analyzers: tuple[Callable[[DataFrame, DataFrame], DataFrame], ...],
             options: ScanOptions = ScanOptions()) -> DataFrame:
    """Processed findings of the rule table and of a user's own analyzers, not yet enriched.

    An analyzer gets ``lines`` (repo, path, language, line, text) and ``blocks`` (start_line, end_line, kind,
    text besides) and returns (repo, path, language, rule_id, line, message, evidence, confidence, signals).
    Its hits come behind those of the table, in the order of the analyzers, then of lines and messages; from
    there on they are treated alike: repeats go, suppressed ones go, one of each fingerprint stays.
    """
    lines, blocks = X.lines(files), X.exception_blocks(files, options.block_mode)
    found = raw_findings(files, options)
    behind = max(e.analyzer_ord for e in emissions(options.custom_rules)) + 1
    for at, analyzer in enumerate(analyzers):
        own = analyzer(lines, blocks).select(
            *X.KEYS, "rule_id", F.col("line").cast("int").alias("line"), "message", "evidence",
            F.lit(ANALYZER).alias("analyzer"), F.col("confidence").cast("double").alias("confidence"),
            "signals", F.lit(behind + at).alias("analyzer_ord"), F.col("line").cast("bigint").alias("seq"))
        found = found.unionByName(own)
    order = (*ORDER, "message", "rule_id", "evidence")
    single = keep_first(found, ("repo", "rule_id", "path", "line", "message"), order)
    return fingerprint_dedupe(suppress(single, suppressions(files, options)), order)


def checked_findings(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``raw_findings`` with ``evidence_valid``: every line of the evidence is in the file.

    The file is at hand where its findings are made, so no join brings the text back."""
    hits = X.rows(files, deduped_array(options), "text")
    checked = hits.selectExpr("*", f"{T.occurs('evidence', 'text')} AS evidence_valid")
    return _describe(checked, options, "evidence_valid")


# ------------------------------------------------------------------------------------ suppression

def suppression_array(lines_: str, directive: str) -> str:
    """``struct<line, rule_id, scope>``; ``line`` is the suppressed one, or that of the comment."""
    def directives(marked: str, kind: str, scope: str, shift: int) -> str:
        # The prefix is an option and may hold characters with a meaning in expressions.
        expression = f"(?U)\\Q{directive}-disable-{kind}\\E\\s+([A-Z]+-\\d+)"
        found = each(marked, lambda h: struct(
            line=f"{h}.line + {shift}",
            rule_id=f"regexp_extract({h}.text, {lit(expression)}, 1)", scope=lit(scope)))
        return keep(found, lambda s: f"{s}.rule_id != ''")
    marked = X.numbered(lines_, lambda x: f"contains({x}, {lit(directive + '-disable-')})")
    return let(marked, lambda m: f"concat({directives(m, 'file', 'file', 0)},"
                                 f" {directives(m, 'next-line', 'line', 1)})")


def _marked(options: ScanOptions, text: str, body) -> str:
    """``body`` over the suppressions of a text, null for a text that holds no directive."""
    return when(f"contains({text}, {lit(options.directive + '-disable-')})",
                let(split_lines(text), lambda ls: body(suppression_array(ls, options.directive))))


def mark_array(options: ScanOptions) -> str:
    """The suppressions of a file, null without any directive."""
    return _marked(options, "text", lambda marks: marks)


def suppressions(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    return X.rows(files, mark_array(options)).select("repo", "path", "rule_id", "scope", "line")


def marks_of(once: DataFrame) -> DataFrame:
    """``suppressions`` of files whose ``marks`` hold ``mark_array`` already."""
    return X.rows(once, "marks").select("repo", "path", "rule_id", "scope", "line")


def suppress(found: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows not covered by a whole-file mark or by a mark on their line."""
    marks = marks.select("repo", "path", "rule_id", "scope", "line").distinct().alias("s")
    rows = found.alias("f")
    same = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in ("repo", "path", "rule_id")]
    covered = (F.col("s.scope") == "file") | (F.col("s.line") == F.col("f.line"))
    return rows.join(marks, [*same, covered], "left_anti")


# ------------------------------------------------------------------------- keep-first on tables

def keep_first(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """First row of each key group in the given order.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a key held
    by a third of all rows sends one row per task instead of all of them into one.
    """
    kept = df.groupBy(*keys).agg(
        F.min_by(F.struct(*df.columns), F.struct(*order)).alias("kept"))
    return kept.select("kept.*")


def dedupe_candidates(df: DataFrame) -> DataFrame:
    return keep_first(df, ("repo", "rule_id", "path", "line", "message"), ORDER)


def merge_findings(own: DataFrame, external: DataFrame) -> DataFrame:
    """Union of both sources, first per (rule, path, line, message, analyzer); own rows first, then
    those of requests in the order of their ids."""
    both = own.withColumn("source_ord", F.lit(0)).unionByName(
        external.withColumn("source_ord", F.lit(1)), allowMissingColumns=True)
    merged = keep_first(both, ("repo", "rule_id", "path", "line", "message", "analyzer"),
                        ("source_ord", *MERGED_ORDER))
    return merged.drop("source_ord")


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", F.expr(
        T.fingerprint("rule_id", "path", "line", "evidence")))


def fingerprint_dedupe(df: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    return keep_first(with_fingerprint(df), ("repo", "fingerprint"), order)


# ------------------------------------------------------------------------------------- the result

def finding_array(options: ScanOptions, text: str = "text", path: str = "path",
                  language: str = "language", hits: str | None = None) -> str:
    """De-duplicated, unsuppressed candidates with fingerprints, first per fingerprint.

    ``hits`` names a column that holds ``deduped_array`` already.
    """
    rule_ids = strings(e.rule.rule_id for e in emissions(options.custom_rules))

    def rule_of(c: str) -> str:
        return f"element_at({rule_ids}, {c}.hit + 1)"

    covered = _marked(options, text, lambda marks: each(marks, lambda s: when(
        f"{s}.scope = 'file'", f"{s}.rule_id", f"concat_ws('@', {s}.rule_id, {s}.line)")))

    def unsuppressed(found: str) -> str:
        return let(covered, lambda marks: when(f"{marks} IS NULL", found, keep(
            found, lambda c: f"NOT array_contains({marks}, {rule_of(c)}) AND NOT array_contains("
                             f"{marks}, concat_ws('@', {rule_of(c)}, {c}.line))")))

    def printed(kept: str) -> str:
        return each(kept, lambda c: struct(
            ord=f"{c}.ord", hit=f"{c}.hit", line=f"{c}.line", evidence=f"{c}.evidence",
            fingerprint=T.fingerprint(rule_of(c), path, f"{c}.line", f"{c}.evidence")))

    deduped = hits or deduped_array(options, text, language)
    return let(let(let(deduped, unsuppressed), printed),
               lambda ps: keep_first_in_row(ps, each(ps, lambda p: f"{p}.fingerprint")))


def findings(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """The processed result of a scan, one narrow stage over the files. Not yet enriched.

    Two steps, because the analyzer has a limit on how deep one expression may nest lambdas.
    """
    matched = files.selectExpr(*X.KEYS, "text", f"{deduped_array(options)} AS hits")
    found = finding_array(options, hits="hits")
    return _describe(X.rows(matched, found), options, "fingerprint")


def found_in(once: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """``findings`` of files that ``metrics.scanned`` has reduced to their findings."""
    return _describe(X.rows(once, "found"), options, "fingerprint")


def enrich(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Title, severity, category, recommendation and sources come from the catalog.

    The catalog is a few rows of known size, so Spark broadcasts it under its own size threshold;
    a catalog above the threshold is joined by shuffle. No hint overrides that check.
    """
    facts = catalog.select(
        F.col("id").alias("rule_id"), F.col("title").alias("rule_title"), "severity", "category",
        "recommendation", "source_refs")
    return found.join(facts, "rule_id")


def ordered(found: DataFrame) -> DataFrame:
    """Report order: worst first, then path, line and rule. A range-partitioned sort.

    The sort samples its input before it shuffles it. The findings are put behind an exchange by
    file first, so that both passes read its output and the corpus is scanned once.
    """
    spread = found.repartition("repo", "path")
    return spread.orderBy(F.expr(T.severity_rank("severity")), "path", "line", "rule_id", "repo",
                          *ORDER)
