"""The rule table: what is reported, where it is looked for, and in which order.

A rule is data: patterns that must and must not occur in a line, a console call or an exception
block. The built-in table is compiled into one bit mask per text, so that every pattern is matched
once and all rules read the same answers. A user adds rules by adding rows (``ScanOptions.custom_rules``,
``read_rules``), as many as they like: these stay a table, in groups by the patterns that many of them share.
A shared pattern is matched once a text; the texts that are left narrow the group to the rules whose literals
they hold, and hits are indexes into the table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from siftspark.functions import patterns as P
from siftspark.functions.sql import both, keep, lit, strings, struct, when
from siftspark.functions.text import Probe, matches

BOTH = ("python", "java")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    scope: str                      # "line", "call" or "block"
    must: tuple[P.Pattern, ...]
    must_not: tuple[P.Pattern, ...]
    message: str
    confidence: float
    signals: tuple[str, ...]
    skip_comments: bool = False


@dataclass(frozen=True)
class Emission:
    """One rule run by one analyzer. Analyzers run in order; ``step`` orders the passes inside."""

    rule: Rule
    languages: tuple[str, ...]
    analyzer_ord: int
    step: int = 0


# ---------------------------------------------------------------------------------------------
# Rule ids, messages, confidences and signals.
# ---------------------------------------------------------------------------------------------
SENSITIVE_LOGGED = Rule(
    "LOG-003", "line", (P.LOG_CALL, P.SENSITIVE), (P.SAFE_TRANSFORM,),
    "Sensitive-looking value appears in a logging call.",
    0.82, ("log_call", "sensitive_token"), skip_comments=True,
)
UNTRUSTED_LOGGED = Rule(
    "LOG-004", "line", (P.LOG_CALL, P.UNTRUSTED_INPUT), (P.SANITIZER,),
    "Untrusted-looking data is logged without visible sanitization.",
    0.66, ("log_call", "untrusted_input", "missing_sanitizer"), skip_comments=True,
)
LOGGING_DISABLED = Rule(
    "LOG-007", "line", (P.DISABLE_LOGGING,), (),
    "Code or configuration appears able to disable logging.",
    0.86, ("logging_disable_signal",), skip_comments=True,
)
RESPONSE_LINE = Rule(
    "ERR-002", "line", (P.TECHNICAL_RESPONSE,), (),
    "Technical exception details appear to be returned or rendered.",
    0.78, ("technical_error_response",), skip_comments=True,
)
CONSOLE_CALL = Rule(
    "LOG-005", "call", (P.CONSOLE_LOG,), (),
    "Exception handling uses console-style logging instead of the standard logger.",
    0.74, ("console_logging",),
)
SWALLOWED = Rule(
    "ERR-003", "block", (), (P.LOG_CALL, P.CONSOLE_LOG, P.PROPAGATION),
    "Caught exception is not logged or propagated.",
    0.78, ("catch_block", "missing_log_or_propagation"),
)
CONSOLE_BLOCK = Rule(
    "LOG-005", "block", (P.CONSOLE_LOG,), (),
    "Exception handling uses console-style logging instead of the standard logger.",
    0.74, ("catch_block", "console_logging"),
)
RESPONSE_BLOCK = Rule(
    "ERR-002", "block", (P.TECHNICAL_RESPONSE,), (),
    "Exception handler appears to expose raw technical error details.",
    0.84, ("catch_block", "technical_error_response"),
)
RETURNED_UNLOGGED = Rule(
    "ERR-001", "block", (P.TECHNICAL_RESPONSE,), (P.LOG_CALL,),
    "Exception details appear to be returned without server-side logging.",
    0.76, ("catch_block", "technical_error_response", "missing_server_log"),
)
MESSAGE_NO_STACK = Rule(
    "ERR-001", "block", (P.LOG_AT_LEVEL, P.MESSAGE_ONLY), (P.STACK_LOGGED,),
    "Exception logging may omit stack context needed for investigation.",
    0.64, ("exception_message_without_stack",),
)
# ------------------------------------------------------------------------ end of fixed values

# Four analyzers: sensitive logging, swallowed exceptions, unsafe responses, console logging (java).
EMISSIONS = (
    Emission(SENSITIVE_LOGGED, BOTH, 0),
    Emission(UNTRUSTED_LOGGED, BOTH, 0),
    Emission(LOGGING_DISABLED, BOTH, 0),
    Emission(SWALLOWED, BOTH, 1),
    Emission(CONSOLE_BLOCK, ("python",), 1),
    Emission(RETURNED_UNLOGGED, BOTH, 1),
    Emission(MESSAGE_NO_STACK, BOTH, 1),
    Emission(RESPONSE_LINE, BOTH, 2, step=0),
    Emission(RESPONSE_BLOCK, BOTH, 2, step=1),
    Emission(RETURNED_UNLOGGED, BOTH, 2, step=1),
    Emission(MESSAGE_NO_STACK, BOTH, 2, step=1),
    Emission(CONSOLE_CALL, ("java",), 3, step=0),
    Emission(CONSOLE_BLOCK, ("java",), 3, step=1),
)


def emissions(custom_rules: tuple[Rule, ...] = ()) -> tuple[Emission, ...]:
    """The built-in table followed by the user's rules, each as an analyzer of its own."""
    extra = tuple(
        item if isinstance(item, Emission) else Emission(item, BOTH, 4 + position)
        for position, item in enumerate(custom_rules)
    )
    return EMISSIONS + extra


def table_width(custom_rules: tuple[Rule, ...]) -> int:
    """A power of two with room for every place in the table."""
    return max(64, 1 << (len(emissions(custom_rules)) - 1).bit_length())


def read_rules(rules: DataFrame) -> tuple[Emission, ...]:
    """Rules of a table, ordered by ``ord``, for ``ScanOptions.custom_rules``.

    Columns: ord, rule_id, scope, languages, must, must_not (arrays of expressions), needs (literals in lower
    case, one of which each match of all of ``must`` holds; may be empty), message, confidence, signals,
    skip_comments. The table is configuration: it becomes part of the plan of every scan.
    """
    def pattern(body: str, needs: list[str]) -> P.Pattern:
        return P.Pattern("custom", body, tuple(needs or ()))

    out = []
    for at, r in enumerate(rules.orderBy("ord").collect()):
        if r["scope"] not in ("line", "call", "block"):
            raise ValueError(f"unknown scope of a rule: {r['scope']}")
        # All of ``must`` holds or no match: the literals may stand with the first expression.
        must = tuple(pattern(p, r["needs"] if k == 0 else []) for k, p in enumerate(r["must"] or ()))
        rule = Rule(r["rule_id"], r["scope"], must, tuple(pattern(p, []) for p in r["must_not"] or ()), r["message"],
                    r["confidence"], tuple(r["signals"] or ()), bool(r["skip_comments"]))
        out.append(Emission(rule, tuple(r["languages"] or BOTH), 4 + at))
    return tuple(out)


def read_redactions(table: DataFrame) -> tuple[P.Redaction, ...]:
    """Redactions of a table with ord, body, mark and needs, for ``ScanOptions.redactions``."""
    return tuple(P.Redaction(r["body"], r["mark"], needs=tuple(r["needs"] or ())) for r in table.orderBy("ord").collect())


@dataclass(frozen=True)
class Gate:
    """What many of the user's rules ask alike: tested once a text, before any of these rules is looked at."""

    block: bool
    must: tuple[P.Pattern, ...] = ()
    must_not: tuple[P.Pattern, ...] = ()
    skip_comments: bool = False

    def opens(self, probe: Probe) -> str:
        tests = [matches(probe, p) for p in self.must] + [f"NOT {matches(probe, p)}" for p in self.must_not]
        if self.skip_comments:
            tests.append(f"NOT {matches(probe, P.COMMENT_LINE)}")
        return both(tests) if tests else "true"


SHARED = 8       # rules that make a pattern worth a test of its own
GATES = 32       # in one plan; the rules of any further ones are tested one by one


def custom_groups(custom_rules: tuple[Rule, ...]) -> dict[Gate, list[tuple[int, Emission]]]:
    """The user's rules with their places in the table, by what many of them ask alike."""
    left = list(enumerate(emissions(custom_rules)))[len(EMISSIONS):]
    out: dict[Gate, list[tuple[int, Emission]]] = {}
    least = SHARED
    # Rules whose own mix of patterns is rare are asked again about more frequent ones only.
    while left and least <= len(left):
        asked = Counter(("must", p) for _, e in left for p in set(e.rule.must))
        asked.update(("not", p) for _, e in left for p in set(e.rule.must_not))
        groups: dict[Gate, list[tuple[int, Emission]]] = {}
        for at, e in left:
            groups.setdefault(Gate(
                e.rule.scope == "block", tuple(p for p in e.rule.must if asked["must", p] >= least),
                tuple(p for p in e.rule.must_not if asked["not", p] >= least), e.rule.skip_comments), []).append((at, e))
        large = sorted((g for g in groups if len(groups[g]) >= SHARED), key=lambda g: -len(groups[g]))
        for gate in large[:max(0, GATES - len(out))]:
            out.setdefault(gate, []).extend(groups.pop(gate))
        left = [rule for members in groups.values() for rule in members]
        least *= 2
    for at, e in left:
        out.setdefault(Gate(e.rule.scope == "block"), []).append((at, e))
    return out


def custom_literal(gate: Gate, members: list[tuple[int, Emission]], step: int) -> str:
    """Rules behind one gate as a constant array: place in the table, order, languages, patterns of their own."""
    def test(p: P.Pattern) -> str:
        groups = [(n,) if isinstance(n, str) else n for n in p.needs]
        needs = ", ".join(strings(g) for g in groups)
        return struct(java=lit(p.java), folds=str(p.ignore_case).lower(),
                      needs=f"array({needs})" if groups else "cast(array() AS array<array<string>>)")

    def tests(patterns: tuple[P.Pattern, ...], asked: tuple[P.Pattern, ...]) -> str:
        left = [p for p in patterns if p not in asked]
        if left:
            return f"array({', '.join(map(test, left))})"
        return "cast(array() AS array<struct<java:string,folds:boolean,needs:array<array<string>>>>)"

    return "array(" + ", ".join(
        struct(hit=str(at), base=f"{(e.analyzer_ord * 2 + e.step) * step + at}L", languages=strings(e.languages),
               must=tests(e.rule.must, gate.must), must_not=tests(e.rule.must_not, gate.must_not),
               code=str(e.rule.skip_comments and not gate.skip_comments).lower())
        for at, e in members) + ")"


def _possible(pattern: str, low: str, odd: str) -> str:
    """The text, lower-cased, holds literals of a pattern, or letters that fold outside ASCII."""
    held = f"exists({pattern}.needs, g -> forall(g, n -> contains({low}, n)))"
    return f"(size({pattern}.needs) = 0 OR {held} OR ({pattern}.folds AND {odd}))"


def custom_possible(literal: str, low: str, odd: str, language: str) -> str:
    """The rules that texts of this language can break whose lower-case forms ``low`` joins."""
    return keep(literal, lambda r: f"array_contains({r}.languages, {language})"
                                   f" AND forall({r}.must, p -> {_possible('p', low, odd)})")


def custom_hits(texts: str, rule: str, odd: str) -> str:
    """The ``struct<text, low>`` that one rule applies to. All literals are looked for before any expression runs.

    The texts are passed over rule by rule, since ``regexp_instr`` keeps its last expression compiled.
    """
    return keep(texts, lambda t: (
        f"forall({rule}.must, p -> {_possible('p', f'{t}.low', odd)})"
        f" AND forall({rule}.must, p -> regexp_instr({t}.text, p.java) > 0)"
        f" AND NOT exists({rule}.must_not, p -> {_possible('p', f'{t}.low', odd)}"
        f" AND regexp_instr({t}.text, p.java) > 0)"
        f" AND NOT ({rule}.code AND {matches(Probe(f'{t}.text', f'{t}.low', odd), P.COMMENT_LINE)})"))


def holds(rule: Rule, probe: Probe, lead: bool = True) -> str:
    """The rule applies to one text. Comment lines are looked at last: few texts get that far."""
    must = rule.must if lead else rule.must[1:]
    tests = [matches(probe, pattern) for pattern in must]
    tests += [f"NOT {matches(probe, pattern)}" for pattern in rule.must_not]
    if rule.skip_comments:
        tests.append(f"NOT {matches(probe, P.COMMENT_LINE)}")
    return both(tests) if tests else "true"


def rule_mask(table: tuple[Emission, ...], scopes: tuple[str, ...], probe: Probe) -> str:
    """Bit ``i`` is set if emission ``i`` applies. Rules that open with the same pattern share it."""
    bits: dict[Rule, int] = {}
    for position, emission in enumerate(table):
        if emission.rule.scope in scopes:
            bits[emission.rule] = bits.get(emission.rule, 0) | (1 << position)
    groups: dict[P.Pattern | None, list[Rule]] = {}
    for rule in bits:
        groups.setdefault(rule.must[0] if rule.must else None, []).append(rule)
    parts = ["0L"]
    for lead, rules in groups.items():
        part = " + ".join(when(holds(r, probe, lead is None), f"{bits[r]}L", "0L") for r in rules)
        parts.append(f"({part})" if lead is None else when(matches(probe, lead), part, "0L"))
    return "(" + " + ".join(parts) + ")"


def language_mask(table: tuple[Emission, ...], language: str) -> str:
    names = sorted({name for emission in table for name in emission.languages})
    cases = " ".join(
        f"WHEN {lit(name)} THEN "
        f"{sum(1 << i for i, e in enumerate(table) if name in e.languages)}L"
        for name in names)
    return f"CASE {language} {cases} ELSE 0L END"
