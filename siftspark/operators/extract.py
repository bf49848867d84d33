"""Extractors: from a file's text to lines, spans and calls.

A file is one row and stays one row while it is cut up. Lines, blocks and symbols are arrays built
and filtered inside that row, and only hits leave it, so extraction needs no shuffle however the
corpus is spread. File size is bounded by the size filter of ``sources.files``, so is each array.
The ``*_array`` functions compose expression text; the others map a files DataFrame
(repo, path, language, text) to rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions import patterns as P
from siftspark.functions.sql import (
    each, each_at, either, folded, fresh, keep, let, lit, struct, when,
)
from siftspark.functions.text import (
    Probe, contains_any, has_folding_letters, indent_of, lstrip, matches, probe, rlike,
    split_lines, strip,
)

KEYS = ("repo", "path", "language")
BLOCK_LINES = 14
HANDLER_LINES = 13
OPEN_END = 20
PY_CLAUSE = r"(?U)^\s*except(?:[\s:(*]|$)"
JAVA_CLAUSE = r"(?U)\bcatch\s*\("
FEED = lit("\n")


def rows(files: DataFrame, array: str, *extra: str) -> DataFrame:
    """One row per array element.

    ``inline_outer`` rather than ``inline``: the latter makes Catalyst add a filter on the size of
    its input, and the whole extraction would be computed a second time for that filter.
    """
    out = files.select(*KEYS, *extra, F.expr(f"inline_outer({array})"))
    return out.where("line IS NOT NULL")


def with_lines(body: Callable[[str], str]) -> str:
    return let(split_lines("text"), body)


def lines(files: DataFrame) -> DataFrame:
    """(repo, path, language, line, text), 1-based."""
    out = files.select(*KEYS, F.expr(f"posexplode_outer({split_lines('text')})")
                       .alias("pos", "text"))
    return out.where("pos IS NOT NULL").selectExpr(*KEYS, "pos + 1 AS line", "text")


def numbered(lines_: str, test: Callable[[str], str]) -> str:
    """``struct<line, text>`` of the lines that pass ``test``."""
    every = each_at(lines_, lambda x, i: struct(line=f"{i} + 1", text=x))
    return keep(every, lambda h: test(f"{h}.text"))


def join_lines(lines_: str, start: str, count: str | int) -> str:
    return f"array_join(slice({lines_}, {start}, {count}), {FEED})"


# ------------------------------------------------------------------------------ indent and braces
#
# Where a block ends is a question for the nearest later line with a level that is small enough. Heads
# and the lines that have a level are sorted together and passed over once, from the last line to the
# first. A stack holds the later lines that can still be an answer: each is less deep than all between
# it and the line at hand. It grows with the nesting of the file, not with its length.

STACK = "array<struct<line:int,level:int,at:int>>"
ENDS = "struct<idx:int,line:int,at:int>"
PASSED = "struct<line:int,kind:int,idx:int,level:int,opens:boolean,after:int,at:int>"


def indent_marks(lines_: str) -> str:
    """``struct<line, indent>`` of the lines that can end an indented block: no blanks, no #."""
    marks = each_at(lines_, lambda x, i: let(lstrip(x), lambda body: struct(
        line=f"{i} + 1",
        indent=when(f"{body} != '' AND NOT startswith({body}, '#')",
                    f"length({x}) - length({body})"))))
    return keep(marks, lambda m: f"{m}.indent IS NOT NULL")


def count_of(text: str, char: str) -> str:
    return f"(length({text}) - length(replace({text}, {lit(char)}, '')))"


def brace_delta(text: str) -> str:
    return f"({count_of(text, '{')} - {count_of(text, '}')})"


def _pushed(stack: str, line: str, level: str, at: str) -> str:
    """The stack with one more line on it. Later lines that are as deep or deeper are no answer now."""
    s = fresh("s")
    return (f"array_prepend(filter({stack}, {s} -> {s}.level < {level}), "
            + struct(line=line, level=level, at=at) + ")")


def _first_below(stack: str, level: str) -> str:
    s = fresh("s")
    return f"get(filter({stack}, {s} -> {s}.level <= {level}), 0)"


def indent_ends(marks: str, heads: str) -> str:
    """``struct<idx, line, at>``: for each head (line, indent, idx) the next mark that is not deeper.

    ``at`` is the place of that mark among the marks; both are null where no mark follows.
    """
    def event(line: str, kind: int, level: str, idx: str, at: str) -> str:
        return struct(line=line, kind=str(kind), level=level, idx=idx, at=at)
    # Backwards a head comes before the mark of its own line, which is no answer.
    events = "reverse(sort_array(concat({}, {})))".format(
        each_at(marks, lambda m, i: event(f"{m}.line", 0, f"{m}.indent", "-1", i)),
        each(heads, lambda h: event(f"{h}.line", 1, f"{h}.indent", f"{h}.idx", "-1")))

    def step(stack: str, e: str) -> str:
        found = let(_first_below(stack, f"{e}.level"), lambda f: struct(
            idx=f"{e}.idx", line=f"{f}.line", at=f"{f}.at"))
        return struct(
            state=when(f"{e}.kind = 1", stack,
                       _pushed(stack, f"{e}.line", f"{e}.level", f"{e}.at")),
            out=when(f"{e}.kind = 1", found))
    return folded(events, f"cast(array() AS {STACK})", ENDS, step)


def brace_marks(lines_: str) -> str:
    """``struct<line, delta, opens, low, after>`` of the lines holding a brace.

    ``low`` is the least depth behind a closing brace of the line, ``after`` the least behind one that
    follows an opening brace, both against the depth before the line; null without such a brace.
    """
    braced = numbered(lines_, lambda x: f"(contains({x}, '{{') OR contains({x}, '}}'))")

    def mark(h: str) -> str:
        acc, piece = fresh("a"), fresh("p")
        opens = count_of(piece, "{")
        depth, seen = f"{acc}.depth + {opens} - 1", f"({acc}.seen OR {opens} > 0)"
        lower = struct(depth=depth, seen=seen, low=f"least({acc}.low, {depth})",
                       after=when(seen, f"least({acc}.after, {depth})", f"{acc}.after"))
        start = struct(depth="0", seen="false", low="cast(NULL AS int)", after="cast(NULL AS int)")
        # The piece behind the last closing brace closes nothing.
        lows = let(f"split({h}.text, {lit('[}]')}, -1)", lambda ps: (
            f"aggregate(slice({ps}, 1, size({ps}) - 1), {start}, ({acc}, {piece}) -> {lower})"))
        return let(lows, lambda low: struct(
            line=f"{h}.line", delta=brace_delta(f"{h}.text"), opens=f"contains({h}.text, '{{')",
            low=f"{low}.low", after=f"{low}.after"))
    return each(braced, mark)


def brace_ends(marks: str, heads: str, exact: bool) -> str:
    """``struct<idx, line, at>``: for each head the line that closes the braces opened at it.

    Heads are (line, more, here, idx). The depth to come back to is that before the head's line and
    ``more``. With ``exact`` the closing brace itself counts and is looked for behind the head's line if
    that opens one (``here``), else from the next opening brace on; otherwise the depth at the ends of
    lines counts, from the first line that opens a brace, the head's own included.
    """
    order = (1, 0) if exact else (0, 1)      # of heads and marks in one line

    def event(line: str, kind: int, idx: str, delta: str, opens: str, low: str, after: str) -> str:
        return struct(line=line, kind=str(kind), idx=idx, delta=delta, opens=opens, low=low,
                      after=after)
    no = "cast(NULL AS int)"
    events = "sort_array(concat({}, {}))".format(
        each(heads, lambda h: event(f"{h}.line", order[0], f"{h}.idx", f"{h}.more", f"{h}.here",
                                    no, no)),
        each(marks, lambda m: event(f"{m}.line", order[1], "-1", f"{m}.delta", f"{m}.opens",
                                    f"{m}.low", f"{m}.after")))

    # Forwards: the depth before each line, that of heads and the least of marks.
    def depths(state: str, e: str) -> str:
        before = when(f"{state}.line = {e}.line", f"{state}.before", f"{state}.depth")
        moved = when(f"{e}.idx < 0", f"{state}.depth + {e}.delta", f"{state}.depth")
        level = when(f"{e}.idx >= 0", f"{before} + {e}.delta",
                     f"{before} + {e}.low" if exact else moved)
        return struct(
            state=struct(line=f"{e}.line", before=before, depth=moved),
            out=struct(line=f"{e}.line", kind=f"{e}.kind", idx=f"{e}.idx", level=level,
                       opens=f"{e}.opens", after=f"{before} + {e}.after", at="0"))

    # Backwards: the stack of lines, and the stack as it was at the next opening brace.
    def closes(state: str, e: str) -> str:
        stack = f"{state}.stack"
        grown = when(f"{e}.level IS NULL", stack, _pushed(stack, f"{e}.line", f"{e}.level", "0"))
        if exact:
            own = struct(line=f"{e}.line", level=f"{e}.after", at="0")
            opened = when(f"{e}.after IS NULL", stack, f"array_prepend({stack}, {own})")
            used = when(f"{e}.opens", stack, f"{state}.opened")
        else:
            opened, used = grown, f"{state}.opened"
        found = let(_first_below(used, f"{e}.level"), lambda f: struct(
            idx=f"{e}.idx", line=f"{f}.line", at="0"))
        return struct(
            state=when(f"{e}.idx >= 0", state, struct(
                stack=grown, opened=when(f"{e}.opens", opened, f"{state}.opened"))),
            out=when(f"{e}.idx >= 0", found))

    start = struct(line="0", before="0", depth="0")
    passed = folded(events, start, PASSED, depths)
    empty = f"cast(array() AS {STACK})"
    return folded(f"reverse({passed})", struct(stack=empty, opened=empty), ENDS, closes)


# --------------------------------------------------------------------------------------- symbols

SYMBOL_TYPE = "array<struct<name:string,kind:string,start_line:int,end_line:int>>"


def _symbol_head(x: str) -> str:
    """``struct<name, kind, braces>`` of the symbol a line declares, or null."""
    def named(pattern: str, possible: str, kind: str, braces: bool) -> str:
        name = f"regexp_extract({x}, {lit('(?U)' + pattern)}, 1)"
        return when(possible, let(name, lambda n: when(
            f"{n} != ''", struct(name=n, kind=kind, braces=str(braces).lower()))))

    has_class, has_call = f"contains({x}, 'class')", f"contains({x}, '(')"
    method_or_function = when(f"{lstrip(f'substring({x}, 1, 1)')} = ''", "'method'", "'function'")
    control = let(lstrip(x), lambda body: either(
        f"startswith({body}, {lit(word)})" for word in P.NOT_A_METHOD))
    return "coalesce(" + ", ".join((
        named(P.PY_CLASS, has_class, "'class'", False),
        named(P.PY_FUNCTION, f"{has_call} AND contains({x}, 'def')", method_or_function, False),
        named(P.JAVA_CLASS, has_class, "'class'", True),
        named(P.JAVA_METHOD, f"{has_call} AND NOT {control}", "'method'", True),
    )) + ")"


def symbol_array(lines_: str) -> str:
    """``struct<name, kind, start_line, end_line>`` in line order."""
    heads = keep(
        each_at(lines_, lambda x, i: struct(line=f"{i} + 1", text=x, sym=_symbol_head(x))),
        lambda h: f"{h}.sym IS NOT NULL")
    count = f"size({lines_})"

    def some(found: str, braces: bool, body: Callable[[str, str], str]) -> str:
        def of(own: str) -> str:
            return when(f"size({own}) > 0", body(own, lines_), f"cast(array() AS array<{ENDS}>)")
        placed = each_at(found, lambda h, i: struct(
            line=f"{h}.line", indent=indent_of(f"{h}.text"), idx=i, more="0", here="false",
            braces=f"{h}.sym.braces"))
        return let(keep(placed, lambda h: f"{h}.braces" if braces else f"NOT {h}.braces"), of)

    def with_ends(found: str) -> str:
        by_brace = some(found, True, lambda own, ls: brace_ends(brace_marks(ls), own, exact=False))
        by_indent = some(found, False, lambda own, ls: let(
            indent_marks(ls), lambda marks: indent_ends(marks, own)))
        # Each head has one end; sorted by their numbers the ends stand beside the heads.
        return let(f"sort_array(concat({by_brace}, {by_indent}))", lambda ends: each_at(
            found, lambda h, i: struct(
                name=f"{h}.sym.name", kind=f"{h}.sym.kind", start_line=f"{h}.line",
                end_line=when(f"{h}.sym.braces",
                              f"coalesce(get({ends}, {i}).line,"
                              f" least({h}.line + {OPEN_END}, {count}))",
                              f"coalesce(get({ends}, {i}).line - 1, {count})"))))

    return let(heads, lambda found: when(
        f"size({found}) = 0", f"cast(array() AS {SYMBOL_TYPE})", with_ends(found)))


def innermost(symbols_: str, lines_: str) -> str:
    """For each of ``lines_`` the name of the symbol around it that starts last, or null, in order.

    A sweep over starts and lines: symbols that have ended leave, the latest start is on top.
    """
    def event(line: str, kind: int, end: str, idx: str, name: str) -> str:
        return struct(line=line, kind=str(kind), end=end, idx=idx, name=name)
    events = "sort_array(concat({}, {}))".format(
        each(symbols_, lambda s: event(f"{s}.start_line", 0, f"{s}.end_line", "-1", f"{s}.name")),
        each_at(lines_, lambda x, i: event(x, 1, "0", i, "cast(NULL AS string)")))

    def step(state: str, e: str) -> str:
        s = fresh("s")
        live = f"filter({state}, {s} -> {s}.end >= {e}.line)"
        return let(live, lambda open_: struct(
            state=when(f"{e}.kind = 1", open_,
                       f"array_prepend({open_}, " + struct(end=f"{e}.end", name=f"{e}.name") + ")"),
            out=when(f"{e}.kind = 1", struct(idx=f"{e}.idx", name=f"get({open_}, 0).name"))))
    found = folded(events, "cast(array() AS array<struct<end:int,name:string>>)",
                   "struct<idx:int,name:string>", step)
    return each(f"sort_array({found})", lambda f: f"{f}.name")


def symbols(files: DataFrame) -> DataFrame:
    found = each(with_lines(symbol_array), lambda s: struct(
        line=f"{s}.start_line", name=f"{s}.name", kind=f"{s}.kind", end_line=f"{s}.end_line"))
    return rows(files, found).selectExpr(*KEYS, "name", "kind", "line AS start_line", "end_line")


# ------------------------------------------------------------------------------ imports and calls

def line_probe(x: str, odd: str) -> Probe:
    return Probe(x, f"lower({x})", odd)


def imports(files: DataFrame) -> DataFrame:
    found = with_lines(lambda ls: each(
        numbered(ls, lambda x: matches(line_probe(x, "false"), P.IMPORT)),
        lambda h: struct(line=f"{h}.line", text=strip(f"{h}.text"))))
    return rows(files, found)


def _with_symbols(lines_: str, array: str, fields: tuple[str, ...]) -> str:
    """Add the innermost symbol to each element; symbols are only looked for if there are any."""
    def named(found: str) -> str:
        names = when(f"size({found}) > 0", let(symbol_array(lines_), lambda syms: innermost(
            syms, each(found, lambda e: f"{e}.line"))))
        return let(names, lambda ns: each_at(found, lambda e, i: struct(
            **{f: f"{e}.{f}" for f in fields}, symbol=f"get({ns}, {i})")))
    return let(array, named)


def call_array(lines_: str, pattern: P.Pattern) -> str:
    """``struct<line, text>`` of the calls, stripped."""
    return let(has_folding_letters("text"), lambda odd: each(
        numbered(lines_, lambda x: let(f"lower({x})", lambda low: matches(
            Probe(x, low, odd), pattern))),
        lambda h: struct(line=f"{h}.line", text=strip(f"{h}.text"))))


def calls(files: DataFrame, pattern: P.Pattern, kind: str) -> DataFrame:
    """Call lines of one kind with the innermost symbol around them."""
    found = with_lines(lambda ls: _with_symbols(ls, call_array(ls, pattern), ("line", "text")))
    return rows(files, found).selectExpr(
        *KEYS, f"{lit(kind)} AS kind", "line", "text", "symbol")


def logger_calls(files: DataFrame) -> DataFrame:
    return calls(files, P.LOG_CALL, "logger")


def console_calls(files: DataFrame) -> DataFrame:
    return calls(files, P.CONSOLE_LOG, "console")


# ------------------------------------------------------------------------------ exception blocks

SPAN_FIELDS = ("line", "end_line", "kind", "text")
SPAN_COLUMNS = (*KEYS, "kind", "line AS start_line", "end_line", "text", "symbol")


def _is_head(x: str) -> str:
    starts = let(strip(x), lambda body: either(
        f"startswith({body}, {lit(head)})" for head in P.BLOCK_HEADS))
    return f"({contains_any(x, ('except', 'catch'))} AND {starts})"


def _span(lines_: str, line: str, count: int, kind: str) -> str:
    return struct(line=line, end_line=f"least({line} + {count - 1}, size({lines_}))", kind=kind,
                  text=join_lines(lines_, line, count))


def window_block_array(lines_: str) -> str:
    """A head line and the thirteen lines after it."""
    return each(numbered(lines_, _is_head), lambda h: _span(
        lines_, f"{h}.line", BLOCK_LINES,
        when(f"contains({h}.text, 'catch')", "'catch'", "'exception'")))


def _python_clauses(lines_: str) -> str:
    heads = numbered(lines_, lambda x: f"(contains({x}, 'except') AND {rlike(x, PY_CLAUSE)})")

    def cut(found: str, marks: str) -> str:
        placed = each_at(found, lambda h, i: struct(
            line=f"{h}.line", indent=indent_of(f"{h}.text"), idx=i))

        # The clause ends with its last statement: blank and comment lines after it are left out.
        def clause(h: str, stop: str) -> str:
            last = f"get({marks}, coalesce({stop}.at, size({marks})) - 1)"
            return let(f"{last}.line", lambda end: struct(
                line=f"{h}.line", end_line=end, kind="'exception'",
                text=lstrip(join_lines(lines_, f"{h}.line", f"{end} - {h}.line + 1"))))
        return let(f"sort_array({indent_ends(marks, placed)})", lambda ends: each_at(
            found, lambda h, i: clause(h, f"get({ends}, {i})")))

    return let(heads, lambda found: when(f"size({found}) > 0", let(
        indent_marks(lines_), lambda marks: cut(found, marks))))


def _clause_text(text: str) -> str:
    """From ``catch`` to the brace that closes it; null if none does."""
    start = struct(depth="0", seen="false", at="0", stop="0")
    acc, piece = fresh("a"), fresh("p")
    opens = count_of(piece, "{")
    depth, seen = f"{acc}.depth + {opens} - 1", f"({acc}.seen OR {opens} > 0)"
    step = struct(depth=depth, seen=seen, at=f"{acc}.at + 1",
                  stop=when(f"{acc}.stop = 0 AND {seen} AND {depth} <= 0",
                            f"{acc}.at + 1", f"{acc}.stop"))

    def cut(pieces: str) -> str:
        # The piece after the last closing brace closes nothing.
        closing = f"slice({pieces}, 1, size({pieces}) - 1)"
        stop = f"aggregate({closing}, {start}, ({acc}, {piece}) -> {step}, {acc} -> {acc}.stop)"
        return let(stop, lambda s: when(
            f"{s} > 0", f"concat(array_join(slice({pieces}, 1, {s}), '}}'), '}}')"))

    return let(f"split({text}, {lit('[}]')}, -1)", cut)


def _java_clauses(lines_: str) -> str:
    heads = numbered(lines_, lambda x: f"(contains({x}, 'catch') AND {rlike(x, JAVA_CLAUSE)}"
                     f" AND NOT {rlike(x, P.COMMENT_LINE.java)})")
    parts = each(heads, lambda h: let(f"regexp_instr({h}.text, {lit(JAVA_CLAUSE)})", lambda pos: struct(
        line=f"{h}.line", before=f"substring({h}.text, 1, {pos} - 1)",
        rest=f"substring({h}.text, {pos})")))

    def cut(h: str, stop: str) -> str:
        def up_to(last: str) -> str:
            more = join_lines(lines_, f"{h}.line + 1", f"{last} - {h}.line")
            return when(f"{last} > {h}.line", f"concat({h}.rest, {FEED}, {more})", f"{h}.rest")
        # Closed in its own line, by the line found, or not at all.
        open_end = let(f"least({h}.line + {OPEN_END}, size({lines_}))", up_to)
        text = (f"coalesce({let(f'{h}.rest', _clause_text)},"
                f" {when(f'{stop}.line IS NOT NULL', let(up_to(f'{stop}.line'), _clause_text))},"
                f" {open_end})")
        return let(text, lambda t: struct(
            line=f"{h}.line", end_line=f"{h}.line + {count_of(t, chr(10))}", kind="'catch'",
            text=t))

    def with_ends(found: str) -> str:
        placed = each_at(found, lambda h, i: struct(
            line=f"{h}.line", more=brace_delta(f"{h}.before"), here=f"contains({h}.rest, '{{')",
            idx=i))
        ends = let(placed, lambda own: brace_ends(brace_marks(lines_), own, exact=True))
        return let(f"sort_array({ends})", lambda es: each_at(
            found, lambda h, i: cut(h, f"get({es}, {i})")))

    return let(parts, lambda found: when(f"size({found}) > 0", with_ends(found)))


def exact_clauses(lines_: str, language: str) -> str:
    return (f"CASE {language} WHEN 'python' THEN {_python_clauses(lines_)}"
            f" WHEN 'java' THEN {_java_clauses(lines_)} END")


def fell_back(lines_: str, language: str) -> str:
    """A file without exact clauses has heads that open line windows."""
    return (f"(exists({lines_}, x -> {_is_head('x')})"
            f" AND coalesce(size({exact_clauses(lines_, language)}), 0) <= 0)")


def block_array(lines_: str, language: str, mode: str) -> str:
    """Exception blocks of a file: exact clauses, or windows where no clause is found."""
    if mode == "window":
        return window_block_array(lines_)
    return let(exact_clauses(lines_, language), lambda found: when(
        f"coalesce(size({found}), 0) > 0", found, window_block_array(lines_)))


def exception_blocks(files: DataFrame, mode: str = "window") -> DataFrame:
    """Blocks as rows. Windows carry the innermost symbol; exact clauses carry none."""
    def found(ls: str) -> str:
        blocks = block_array(ls, "language", mode)
        if mode == "window":
            return _with_symbols(ls, blocks, SPAN_FIELDS)
        return each(blocks, lambda b: struct(
            **{f: f"{b}.{f}" for f in SPAN_FIELDS}, symbol="cast(NULL AS string)"))
    return rows(files, with_lines(found)).selectExpr(*SPAN_COLUMNS)


# ------------------------------------------------------------------------------- handler contexts

def _contexts(files: DataFrame, kind: str) -> DataFrame:
    def test(x: str, odd: str) -> str:
        def on(low: str) -> str:
            p = Probe(x, low, odd)
            over = matches(p, P.GLOBAL_HANDLER)
            if kind == "global_exception_handler":
                return over
            return f"({matches(p, P.API_HANDLER)} AND NOT {over})"
        return let(f"lower({x})", on)

    def found(ls: str) -> str:
        spans = let(has_folding_letters("text"), lambda odd: each(
            numbered(ls, lambda x: test(x, odd)),
            lambda h: _span(ls, f"{h}.line", HANDLER_LINES, lit(kind))))
        return _with_symbols(ls, spans, SPAN_FIELDS)

    return rows(files, with_lines(found)).selectExpr(*SPAN_COLUMNS)


def api_handlers(files: DataFrame) -> DataFrame:
    return _contexts(files, "api_handler")


def global_handlers(files: DataFrame) -> DataFrame:
    return _contexts(files, "global_exception_handler")


def predicate_flags(files: DataFrame) -> DataFrame:
    """One boolean per predicate and line."""
    return lines(files).selectExpr(
        *KEYS, "line", *[f"{matches(probe('text'), p)} AS {p.name}" for p in P.LINE_PREDICATES])
