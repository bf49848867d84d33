"""Snippets: the pieces of a file that are shown to a reviewer.

Windows around findings come first, then hotspots. Windows, their de-duplication and the cap per
file stay inside the file's row; only the limit over a whole run orders rows, and Spark keeps the
first ones of each task for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import patterns as P
from siftspark.functions import text as T
from siftspark.functions.sql import each, each_at, folded, keep, let, lit, strings, struct, when
from siftspark.functions.text import contains_any, has_folding_letters, rlike, split_lines
from siftspark.operators import extract as X
from siftspark.operators.findings import candidate_array, deduped_array, keep_first_in_row
from siftspark.operators.rules import emissions
from siftspark.options import ScanOptions

HOTWORD_JAVA = "(?iU)(" + "|".join(P.HOTWORDS) + ")"


def is_hot(text: str, odd: str) -> str:
    """The text holds a hot word. Lower-casing and a byte search say the same as the expression,
    unless letters fold outside ASCII."""
    return when(odd, rlike(text, HOTWORD_JAVA),
                let(f"lower({text})", lambda low: contains_any(low, P.HOTWORDS)))


def _window(lines_: str, line: str, radius: int) -> tuple[str, str]:
    return f"greatest(1, {line} - {radius})", f"least(size({lines_}), {line} + {radius})"


def _hot_lines(lines_: str, odd: str, radius: int) -> str:
    def window(h: str) -> str:
        start, end = _window(lines_, f"{h}.line", radius)
        return struct(start_line=start, end_line=end, text="cast(NULL AS string)", strip="false")
    return each(X.numbered(lines_, lambda x: is_hot(x, odd)), window)


def _hot_spans(lines_: str, odd: str, language: str) -> str:
    """Functions, classes, methods and clauses that hold a hot word, in line order.

    Symbols nest, so their texts together may be many times the file. No hot word holds a line
    break: a symbol is hot if one of its lines is, and no text is cut to find that out. A clause
    opens with a hot word and always is.
    """
    def event(line: str, kind: int, end: str) -> str:
        return struct(line=line, kind=str(kind), end=end)

    # Backwards over symbols and hot lines: a symbol is hot if the next hot line is inside it.
    def step(state: str, e: str) -> str:
        hot = f"{e}.kind = 0 AND {state} <= {e}.end"
        return struct(state=when(f"{e}.kind = 1", f"{e}.line", state),
                      out=when(hot, struct(line=f"{e}.line", end=f"{e}.end")))

    wanted = keep(X.symbol_array(lines_), lambda s:
                  f"{language} = 'python' OR ({language} = 'java' AND {s}.kind = 'method')")
    hot_lines = X.numbered(lines_, lambda x: is_hot(x, odd))
    events = "reverse(sort_array(concat({}, {})))".format(
        each(wanted, lambda s: event(f"{s}.start_line", 0, f"{s}.end_line")),
        each(hot_lines, lambda h: event(f"{h}.line", 1, "0")))
    found = folded(events, f"{(1 << 31) - 1}", "struct<line:int,end:int>", step)
    declared = each(found, lambda f: struct(
        start_line=f"{f}.line", end_line=f"{f}.end", text="cast(NULL AS string)", strip="true"))
    clauses = each(X.block_array(lines_, language, "scoped"), lambda b: struct(
        start_line=f"{b}.line", end_line=f"{b}.end_line", text=f"{b}.text", strip="false"))
    return f"array_sort(concat({declared}, {clauses}))"


FIRST_LINES = 200


def _body(lines_: str, s: str, clip_chars: int) -> str:
    """Clipped text of a span. The first lines are mostly enough to fill it; the rest of a long span
    is only joined where they are not."""
    count = f"{s}.end_line - {s}.start_line + 1"

    def cut(lines: str) -> str:
        return let(X.join_lines(lines_, f"{s}.start_line", lines), lambda t: when(
            f"{s}.strip", T.lstrip(t), t))
    own = let(cut(f"least({count}, {FIRST_LINES})"), lambda t: when(
        f"length({t}) > {clip_chars} OR {count} <= {FIRST_LINES}", t, cut(count)))
    return let(f"coalesce({s}.text, {own})", lambda t: T.clip(t, clip_chars))


def hotspot_array(lines_: str, odd: str, language: str, options: ScanOptions) -> str:
    if options.block_mode == "window":
        return _hot_lines(lines_, odd, options.window_radius)
    return _hot_spans(lines_, odd, language)


def snippet_array(options: ScanOptions, text: str = "text", language: str = "language",
                  bodies: bool = True, hits: str | None = None) -> str:
    """``struct<line, phase, seq, start_line, end_line, reason, text>``, first per line range.

    Without ``bodies`` the text of line windows stays null: it can be cut from the file again. ``hits``
    names a column that holds ``deduped_array`` already.
    """
    rule_ids = strings(e.rule.rule_id for e in emissions(options.custom_rules))

    def around_findings(lines_: str) -> str:
        def window(c: str) -> str:
            start, end = _window(lines_, f"{c}.line", options.window_radius)
            rule = f"element_at({rule_ids}, {c}.hit + 1)"
            return struct(line=f"{c}.line", phase="0", seq=f"{c}.ord", start_line=start,
                          end_line=end, reason=f"concat('deterministic finding ', {rule})",
                          text="cast(NULL AS string)", strip="false")
        return each(hits or deduped_array(options, text, language), window)

    def hotspots_(lines_: str, odd: str) -> str:
        return each_at(hotspot_array(lines_, odd, language, options), lambda s, i: struct(
            line=f"{s}.start_line", phase="1", seq=f"cast({i} AS bigint)",
            start_line=f"{s}.start_line", end_line=f"{s}.end_line",
            reason="'semantic hotspot'", text=f"{s}.text", strip=f"{s}.strip"))

    def build(lines_: str, odd: str) -> str:
        every = f"concat({around_findings(lines_)}, {hotspots_(lines_, odd)})"
        first = let(every, lambda a: keep_first_in_row(a, each(
            a, lambda s: f"{s}.start_line * 4294967296L + {s}.end_line")))
        if not bodies:
            return first
        return each(first, lambda s: struct(
            line=f"{s}.line", phase=f"{s}.phase", seq=f"{s}.seq", start_line=f"{s}.start_line",
            end_line=f"{s}.end_line", reason=f"{s}.reason",
            text=_body(lines_, s, options.clip_chars)))

    known = struct(lines=split_lines(text), odd=has_folding_letters(text))
    return let(known, lambda k: build(f"{k}.lines", f"{k}.odd"))


def snippets(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """All snippets of a run; ``phase`` and ``seq`` give the order inside a file."""
    return X.rows(files, snippet_array(options)).select(
        *X.KEYS, "start_line", "end_line", "text", "reason", "phase", "seq")


def first_snippets(found: DataFrame, limit: int) -> DataFrame:
    """The first ones of a run: all finding windows before all hotspots, files in path order."""
    return found.orderBy("phase", "path", "repo", "seq").limit(limit)


def hotspots(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Hotspots alone, before they are compared with finding windows."""
    def build(lines_: str, odd: str) -> str:
        return each(hotspot_array(lines_, odd, "language", options), lambda s: struct(
            line=f"{s}.start_line", start_line=f"{s}.start_line", end_line=f"{s}.end_line",
            text=_body(lines_, s, options.clip_chars)))
    found = X.with_lines(lambda ls: let(has_folding_letters("text"), lambda odd: build(ls, odd)))
    return X.rows(files, found).select(*X.KEYS, "start_line", "end_line", "text")


def candidate_snippets(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Windows around candidates with symbol, rule and signals; redacted, then identified, clipped.

    A file gives at most ``max_snippets_per_file``, the first ones in emission order.
    """
    table = emissions(options.custom_rules)
    facts = "array(" + ", ".join(struct(
        rule_id=lit(e.rule.rule_id), signals=strings(e.rule.signals),
        named=str(e.rule.scope == "call"
                  or (e.rule.scope == "block" and options.block_mode == "window")).lower())
        for e in table) + ")"

    def build(lines_: str) -> str:
        def window(c: str) -> str:
            start, end = _window(lines_, f"{c}.line", options.window_radius)
            return struct(line=f"{c}.line", ord=f"{c}.ord", start_line=start, end_line=end,
                          fact=f"element_at({facts}, {c}.hit + 1)")
        every = each("candidates", window)
        first = let(every, lambda a: keep_first_in_row(a, each(
            a, lambda s: f"{s}.start_line * 4294967296L + {s}.end_line")))
        capped = f"slice({first}, 1, {options.max_snippets_per_file})"

        def finish(s: str, i: str, names: str) -> str:
            return struct(
                line=f"{s}.line", start_line=f"{s}.start_line", end_line=f"{s}.end_line",
                text=X.join_lines(lines_, f"{s}.start_line",
                                  f"{s}.end_line - {s}.start_line + 1"),
                rule_id=f"{s}.fact.rule_id",
                symbol=when(f"{s}.fact.named", f"get({names}, {i})"),
                signals=f"{s}.fact.signals", seq=f"{s}.ord")
        def names_of(cs: str) -> str:
            return when(f"exists({cs}, x -> x.fact.named)", let(
                X.symbol_array(lines_), lambda syms: X.innermost(
                    syms, each(cs, lambda s: f"{s}.line"))))
        return let(capped, lambda cs: let(names_of(cs), lambda names: each_at(
            cs, lambda s, i: finish(s, i, names))))

    # Two steps, because the analyzer has a limit on how deep one expression may nest lambdas.
    matched = files.select(*X.KEYS, "text", F.expr(candidate_array(options)).alias("candidates"))
    cut = X.rows(matched, X.with_lines(build))
    if options.redact:
        cut = cut.withColumn("text", F.expr(T.redact("text", options.redactions)))
    return cut.selectExpr(
        *X.KEYS, "start_line", "end_line", f"{T.clip('text', options.clip_chars)} AS text",
        "concat('candidate rules: ', rule_id) AS reason",
        f"{T.snippet_id('path', 'start_line', 'end_line', 'text')} AS snippet_id", "symbol",
        "array(rule_id) AS candidate_rule_ids", "signals", "seq")


def redact_snippets(found: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Masked text; an id, where there is none, is that of the text before masking."""
    if not options.redact:
        return found
    known = "snippet_id" if "snippet_id" in found.columns else "cast(NULL AS string)"
    identity = T.snippet_id("path", "start_line", "end_line", "text")
    return found.withColumns({
        "snippet_id": F.expr(f"coalesce({known}, {identity})"),
        "text": F.expr(T.redact("text", options.redactions)),
    })
