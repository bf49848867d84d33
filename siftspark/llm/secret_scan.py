"""Secret scans: base patterns, and a battery of randomness tests over all long tokens.

Base spans are the matches of three patterns. The method looks at every other run of 20 or more token
characters. A short prefix (``sk_live_``) is set aside, separators and pads are left out, and the encoding is
inferred from what remains: hex, base 32, base 36, base 62 (base 64 without its two signs) or letters alone.

Each token gets one number, the evidence that it was drawn at random from that alphabet and not written:
the log-likelihood ratio of the two. Written text keeps to one kind of character and prefers common letters. A
written token reaches a ratio of t with a chance of at most exp(-t), however long it is, so this is a p-value
in which length counts. From it the battery takes what speaks against chance: chi-squared over the alphabet's
characters, runs of kinds, and serial correlation of neighbours, each with its own -ln p (a Chernoff bound, or
half the squared deviation). So ``abcdefgh...`` or one character many times loses all it won. The numbers of all tokens of
all documents go through the step-up rule that controls the share of false discoveries; a histogram of bounded
size suffices for it.

Everything is an expression over the row, and its work grows with the text; only the histogram and its
threshold leave it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.functions.sql import folded, let, struct
from siftspark.llm.shared import written

# The base kinds in their order, with the pattern, the group that must be long and its length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}+", 0, 24),
)
KINDS = ("assign", "access", "hex", "random")
SPAN = "struct<s:int,e:int,k:int,token:string>"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
PREFIX = r"^(?:[A-Za-z]{2,8}[_-]){1,2}(?=[A-Za-z0-9+/_=-]{16})"
LEAST = 16  # characters that are tested
FALSE_DISCOVERIES = 0.01
PLAIN_CHANGES = 0.08  # of the kind of character, from one to the next in plain text
# Fixed value: letters a to z in ten thousand of plain text, rounded; rare ones count as 20.
PLAIN_LETTERS = (800, 150, 300, 420, 1250, 220, 200, 560, 730, 20, 70, 400, 250, 700, 750, 190, 20, 610, 640, 900, 280, 100, 210, 20, 190, 20)
STEP = 0.25  # of the histogram of -ln(p)
TOP = 400  # its last class holds all larger values
FREE = 1.5  # of the battery's three halves of squares, what chance itself brings


def _raw(pattern: str) -> str:
    return 'r"' + pattern.replace('"', r"\x22") + '"'


def _spans(text: str, kind: str, pattern: str, group: int, least: int) -> str:
    """SQL: (start, end, kind, token) of all matches whose group is long enough, in code points.

    Spark has no function for all places of a pattern. The text between the matches is what split()
    leaves, so places are running sums of lengths. Only long runs keep their text, as ``token``.
    """
    rank = KINDS.index(kind)
    token = "m.m" if kind == "random" else "cast(NULL AS string)"
    matched = struct(found=f"regexp_extract_all({text}, {_raw(pattern)}, 0)", groups=f"regexp_extract_all({text}, {_raw(pattern)}, {group})")
    # Gap k, match k: both arrays are walked at once, the running place is carried along.
    pairs = let(matched, lambda m: (
        f"transform(split({text}, {_raw(pattern)}, -1), (gap, i) -> named_struct('g', char_length(gap),"
        f" 'm', get({m}.found, i), 'x', coalesce(char_length(get({m}.groups, i)), 0)))"))

    def step(at: str, t: str) -> str:
        start = f"({at} + {t}.g)"
        end = f"({start} + coalesce(char_length({t}.m), 0))"
        span = struct(s=start, e=end, k=str(rank), token=token.replace("m.m", f"{t}.m"))
        return struct(state=end, out=f"if({t}.x >= {least}, {span}, NULL)")
    walk = folded(pairs, "0", SPAN, step)
    return f"if({text} rlike {_raw(pattern)}, {walk}, cast(array() AS array<{SPAN}>))"


def _code(c: str) -> str:
    """SQL: place of a character in 0-9 a-z A-Z; null for all others."""
    return (f"CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 WHEN {c} BETWEEN 'a' AND 'z' THEN ascii({c}) - 87"
            f" WHEN {c} BETWEEN 'A' AND 'Z' THEN ascii({c}) - 29 END")


def _kind(v: str) -> str:
    return f"CASE WHEN {v} < 10 THEN 0 WHEN {v} < 36 THEN 1 ELSE 2 END"


def token_score(token: str) -> str:
    """SQL: the evidence for a random token, less what the battery holds against it; null if it is too short."""
    plain = [math.log(0.1)] * 10 + [math.log(x / sum(PLAIN_LETTERS)) for x in PLAIN_LETTERS] * 2
    weights = "array(" + ", ".join(f"{x!r}D" for x in plain) + ")"

    def of_values(v: str) -> str:
        n = f"cast(size({v}) AS double)"
        count = lambda low, high: f"cast(size(filter({v}, x -> x >= {low} AND x < {high})) AS double)"
        squares = f"aggregate(array_distinct({v}), 0D, (a, x) -> a + pow(cast(size(filter({v}, y -> y = x)) AS double), 2))"
        changes = f"cast(size(filter({v}, (x, i) -> i > 0 AND ({_kind('x')}) <> ({_kind(f'get({v}, i - 1)')}))) AS double)"
        total = f"aggregate({v}, 0D, (a, x) -> a + x)"
        second = f"aggregate({v}, 0D, (a, x) -> a + x * x)"
        lagged = f"aggregate(transform({v}, (x, i) -> cast(x AS double) * coalesce(get({v}, i - 1), 0)), 0D, (a, x) -> a + x)"
        written_ = f"aggregate({v}, 0D, (a, x) -> a + get({weights}, x))"
        sums = let(
            f"named_struct('n', {n}, 'd', {count(0, 10)}, 'l', {count(10, 36)}, 'u', {count(36, 62)},"
            f" 'hex', array_max({v}) < 16, 'upper_hex', NOT exists({v}, x -> x >= 42 OR x >= 10 AND x < 36),"
            f" 'base32', NOT exists({v}, x -> x < 2 OR x >= 8 AND x < 36), 'lower32', NOT exists({v}, x -> x < 2 OR x >= 8 AND x < 10 OR x >= 36),"
            f" 'squares', {squares}, 'changes', {changes}, 'sum', {total}, 'sum2', {second}, 'written', {written_},"
            f" 'lag', {lagged}, 'first', cast(get({v}, 0) AS double), 'last', cast(get({v}, size({v}) - 1) AS double))", _tests)
        return f"if(size({v}) < {LEAST}, cast(NULL AS double), {sums})"
    core = f"regexp_replace({token}, {_raw(PREFIX)}, '')"
    values = f"filter(transform(split({core}, ''), c -> {_code('c')}), x -> x IS NOT NULL)"
    return let(values, of_values)


def _tests(f: str) -> str:
    """SQL over the sums of a token."""
    def alphabet(d: int, lower: int, upper: int) -> str:
        return f"named_struct('d', {d}D, 'l', {lower}D, 'u', {upper}D)"
    # The encoding: how many digits, lower-case and upper-case characters its alphabet has.
    sizes = (
        f"CASE WHEN {f}.l + {f}.u = 0 THEN {alphabet(10, 0, 0)}"
        f" WHEN {f}.hex AND {f}.d > 0 THEN {alphabet(10, 6, 0)} WHEN {f}.upper_hex AND {f}.d > 0 THEN {alphabet(10, 0, 6)}"
        f" WHEN {f}.d = 0 AND {f}.u = 0 THEN {alphabet(0, 26, 0)} WHEN {f}.d = 0 AND {f}.l = 0 THEN {alphabet(0, 0, 26)}"
        f" WHEN {f}.d = 0 THEN {alphabet(0, 26, 26)}"
        f" WHEN {f}.base32 THEN {alphabet(6, 0, 26)} WHEN {f}.lower32 THEN {alphabet(6, 26, 0)}"
        f" WHEN {f}.u = 0 THEN {alphabet(10, 26, 0)} WHEN {f}.l = 0 THEN {alphabet(10, 0, 26)}"
        f" ELSE {alphabet(10, 26, 26)} END")

    def battery(a: str) -> str:
        n, cells, q = f"{f}.n", f"({a}.d + {a}.l + {a}.u)", PLAIN_CHANGES
        # Written: a first kind, then mostly the same one, and in each kind the letters of plain text.
        written_ = (f"({f}.written + ln(1D / 3) + {f}.changes * ln({q / 2}D) + ({n} - 1 - {f}.changes) * ln({1 - q}D))")
        ratio = f"(- {n} * ln({cells}) - {written_})"
        # Chi-squared of equal cells, too uneven or too even for chance: Chernoff's bound of its -ln p.
        x, df = f"greatest({f}.squares * {cells} / {n} - {n}, 1e-6D)", f"({cells} - 1D)"
        uneven = f"0.5D * ({x} - {df} - {df} * ln({x} / {df}))"
        # Runs of kinds, two-sided; an alphabet of one kind has none.
        same = f"(({a}.d * {a}.d + {a}.l * {a}.l + {a}.u * {a}.u) / {cells} / {cells})"
        runs = (f"if({same} >= 1, 0D, ({f}.changes - ({n} - 1) * (1 - {same}))"
                f" / sqrt(greatest(({n} - 1) * (1 - {same}) * {same} * 1.5D, 1D)))")
        mean = f"({f}.sum / {n})"
        variance = f"greatest({f}.sum2 / {n} - {mean} * {mean}, 1e-9D)"
        serial = (f"(({f}.lag - {mean} * (2 * {f}.sum - {f}.first - {f}.last) + ({n} - 1) * {mean} * {mean} + {variance})"
                  f" / ({variance} * sqrt({n})))")
        against = " + ".join((uneven, *(f"0.5D * pow({z}, 2)" for z in (runs, serial))))
        return f"{ratio} - greatest(0D, {against} - {FREE}D)"
    return let(sizes, battery)


def candidates(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Every row with ``base`` (spans) and ``tokens`` (spans with scores), and its columns as ``row`` if asked."""
    text = "text"
    more = [f"struct({', '.join(f'`{c}`' for c in docs.columns)}) AS row"] if carry else []
    both = f"concat({', '.join(_spans(text, *b) for b in BASE)})"
    base = f"array_sort(transform({both}, s -> named_struct('s', s.s, 'e', s.e, 'k', s.k)))"
    found = _spans(text, "random", TOKEN, 0, 20)
    row = docs.selectExpr(*more, f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    scored = f"transform({found}, s -> named_struct('s', s.s, 'e', s.e, 'k', s.k, 'score', {token_score('s.token')}))"
    return row.selectExpr("*", f"{base} AS base", f"{scored} AS tokens")


def _apart(base: str, tokens: str) -> str:
    """SQL: the tokens that no base span overlaps, by one pass in each direction over both, sorted."""
    event = "struct<s:int,e:int,k:int,token:boolean>"
    both = (f"sort_array(concat(transform({base}, b -> named_struct('s', b.s, 'e', b.e, 'k', b.k, 'token', false)),"
            f" transform({tokens}, t -> named_struct('s', t.s, 'e', t.e, 'k', t.k, 'token', true))))")

    def ahead(reach: str, x: str) -> str:  # a base span that begins before reaches into the token
        clear = f"NOT {x}.token OR {reach} <= {x}.s"
        return struct(state=f"if({x}.token, {reach}, greatest({reach}, {x}.e))", out=f"if({clear}, {x}, NULL)")

    def back(following: str, x: str) -> str:  # the next base span begins inside the token
        return struct(state=f"if({x}.token, {following}, {x}.s)", out=f"if({x}.token AND {following} >= {x}.e, {x}, NULL)")
    once = folded(both, "0", event, ahead)
    found = folded(f"reverse({once})", f"{(1 << 31) - 1}", event, back)
    return f"transform(reverse({found}), x -> named_struct('s', x.s, 'e', x.e, 'k', x.k))"


def threshold(found: DataFrame, share: float = FALSE_DISCOVERIES) -> float:
    """The least score at which at most ``share`` of the tokens beyond it are false (step-up rule)."""
    counts = (
        found.selectExpr("explode(tokens) AS t")
        .selectExpr(f"cast(least(coalesce(floor(t.score / {STEP}), -1), {TOP}) AS int) AS step")
        .groupBy("step").count().collect()  # at most TOP + 2 rows
    )
    by_step = {r["step"]: r["count"] for r in counts}
    total, beyond, chosen = sum(by_step.values()), 0, math.inf
    for step in sorted((s for s in by_step if s >= 0), reverse=True):
        beyond += by_step[step]
        if math.exp(-step * STEP) * total <= share * beyond:
            chosen = step * STEP
    return chosen


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """([row,] id_col, base, spans): arrays of (s, e, k) with k the place in ``KINDS``, in code points.

    ``spans`` holds the base spans and the tokens that the tests find, but for those inside a base span.
    Null and empty texts have none. Rows that repeat are scanned each; null ids stay null; other columns
    are ignored; an empty table gives an empty result. Spans with their scores are written once.
    """
    more = ["row"] if carry else []
    held = written(candidates(docs, id_col, text_col, carry).select(*more, "id", "base", "tokens"), "spans")
    least = threshold(held)
    limit = f"{least!r}D" if math.isfinite(least) else "double('Infinity')"
    new = _apart("base", f"filter(tokens, t -> t.score >= {limit})")
    return held.selectExpr(*more, f"id AS `{id_col}`", "base", f"array_sort(concat(base, {new})) AS spans")


def spelled(spans: str) -> str:
    """SQL: spans as kind:start:end by start, then kind as listed, joined by commas."""
    names = f"array({', '.join(repr(k) for k in KINDS)})"
    ordered = f"array_sort(transform({spans}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))"
    return f"array_join(transform({ordered}, x -> concat(get({names}, x.k), ':', x.s, ':', x.e)), ',')"


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans string) for each row, as ``scanned`` finds them."""
    count = "cast(size(filter(base, x -> x.k = {})) AS bigint) AS n_{}"
    return scanned(docs, id_col, text_col).selectExpr(
        f"`{id_col}`", *(count.format(k, name) for k, name in enumerate(KINDS[:3])),
        f"sha2({spelled('base')}, 256) AS base_sha256", f"{spelled('spans')} AS spans")


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, every span in the text replaced by a mask. Null texts stay null."""
    found = scanned(docs, id_col, text_col, carry=True)
    # Spans in the order of their starts; the text is taken from the row that was scanned.
    text = masked(f"row.`{text_col}`", "spans")
    return found.selectExpr(*(
        f"{text} AS `{c}`" if c == text_col else f"row.`{c}` AS `{c}`" for c in docs.columns))


PIECE = 4_096


def masked(text: str, spans: str, mask: str = "[secret]") -> str:
    """SQL: a text with its spans, overlapping ones as one, replaced by ``mask``.

    ``spans`` come in the order of their starts. The text is cut into pieces once, so that a stretch of it is
    found without counting characters from the beginning each time.
    """
    stretch = "struct<a:int,b:int,mask:boolean>"

    def step(at: str, x: str) -> str:
        return struct(state=f"greatest({at}, {x}.e)", out=f"if({x}.s >= {at}, named_struct('a', {at}, 'b', {x}.s, 'mask', true), NULL)")

    def cut(pieces: str, t: str) -> str:
        first, last = f"cast({t}.a div {PIECE} AS int)", f"cast({t}.b div {PIECE} AS int)"
        begin, end = f"{t}.a % {PIECE}", f"{t}.b % {PIECE}"
        inside = f"substring(get({pieces}, {first}), {begin} + 1, {t}.b - {t}.a)"
        across = (f"concat(substring(get({pieces}, {first}), {begin} + 1), array_join(slice({pieces}, {first} + 2,"
                  f" greatest({last} - {first} - 1, 0)), ''), coalesce(substring(get({pieces}, {last}), 1, {end}), ''))")
        return f"concat(coalesce(if({first} = {last}, {inside}, {across}), ''), if({t}.mask, '{mask}', ''))"

    def whole(kept: str) -> str:
        # A stretch ends where a span begins; the next begins where the widest span so far ends.
        end = f"aggregate({spans}, 0, (acc, x) -> greatest(acc, x.e))"
        every = f"array_append({kept}, named_struct('a', {end}, 'b', char_length({text}), 'mask', false))"
        pieces = f"regexp_extract_all({text}, '(?s).{{1,{PIECE}}}', 0)"
        return let(pieces, lambda ps: f"array_join(transform({every}, t -> {cut(ps, 't')}), '')")
    return f"if(size({spans}) = 0, {text}, {let(folded(spans, '0', stretch, step), whole)})"
