"""Text expressions shared by all operators, as SQL expression text (see ``functions.sql``)."""

from __future__ import annotations

from dataclasses import dataclass

from siftspark.functions.patterns import FOLDS, REDACTIONS, Pattern, Redaction, guard
from siftspark.functions.sql import both, each, either, fresh, let, lit, struct, when

# The characters Python counts as white space, so that strip() means the same on both sides.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
RARE_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
FOLDING_LETTERS = tuple("".join(FOLDS.values()))

SEVERITIES = ("critical", "high", "medium", "low", "info")  # fixed order, worst first
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning",
                "low": "note", "info": "note"}              # fixed values


@dataclass(frozen=True)
class Probe:
    """A text, its lower-case form and whether it holds letters that fold outside ASCII."""

    raw: str
    low: str
    odd: str


def contains_any(text: str, words: tuple[str | tuple[str, ...], ...]) -> str:
    """A word that contains another one of the list adds nothing and is left out."""
    single = [w for w in words if isinstance(w, str)]
    tests = [f"contains({text}, {lit(w)})" for w in single
             if not any(o != w and o in w for o in single)]
    tests += [both(f"contains({text}, {lit(w)})" for w in group)
              for group in words if not isinstance(group, str)]
    return either(tests)


def has_folding_letters(text: str) -> str:
    return contains_any(text, FOLDING_LETTERS)


def probe(text: str) -> Probe:
    return Probe(text, f"lower({text})", has_folding_letters(text))


def rlike(text: str, expression: str) -> str:
    return f"rlike({text}, {lit(expression)})"


def matches(p: Probe, pattern: Pattern) -> str:
    """``pattern`` occurs in the text; byte search first, expression only where it can succeed."""
    exact = rlike(p.raw, pattern.java)
    if not pattern.needs:
        return exact
    possible = contains_any(p.low, pattern.needs)
    if pattern.ignore_case:
        possible = f"({possible} OR {p.odd})"
    return f"({possible} AND {exact})"


def split_lines(text: str) -> str:
    """Lines of ``text`` as Python's ``splitlines`` gives them: no empty last line.

    Most texts break at line feeds only. A byte search for the other breaks is far cheaper than an
    expression tried at every character, so the expression runs only where one of them occurs.
    """
    feed = lit("\n")
    plain = when(f"endswith({text}, {feed})", f"substring({text}, 1, length({text}) - 1)", text)
    body = f"regexp_replace({text}, {lit(f'(?:{LINE_BREAK})' + chr(92) + 'z')}, '')"
    return (
        f"CASE WHEN {text} = '' THEN cast(array() AS array<string>)"
        f" WHEN {contains_any(text, RARE_BREAKS)} THEN split({body}, {lit(LINE_BREAK)}, -1)"
        f" ELSE split({plain}, {feed}, -1) END"
    )


def strip(text: str) -> str:
    return f"btrim({text}, {lit(WHITESPACE)})"


def lstrip(text: str) -> str:
    return f"ltrim({lit(WHITESPACE)}, {text})"


def rstrip(text: str) -> str:
    return f"rtrim({lit(WHITESPACE)}, {text})"


def indent_of(line: str) -> str:
    return f"(length({line}) - length({lstrip(line)}))"


def clip(text: str, max_chars: int = 5000) -> str:
    return when(f"length({text}) <= {max_chars}", text,
                f"concat(substring({text}, 1, {max_chars}), {lit(chr(10) + '...')})")


def shorten(text: str, max_lines: int = 12) -> str:
    """First lines of a stripped block, each right-stripped, with a mark if some were left out."""
    def cut(lines: str) -> str:
        kept = f"array_join({each(f'slice({lines}, 1, {max_lines})', rstrip)}, {lit(chr(10))})"
        more = when(f"size({lines}) > {max_lines}", lit("\n..."), "''")
        return f"concat({kept}, {more})"
    return let(strip(text), lambda t: let(split_lines(t), cut))


def occurs(evidence: str, text: str) -> str:
    """Whether every line of the evidence is in the text, but for the mark of lines left out."""
    return f"forall(split({evidence}, {lit(chr(10))}), l -> l = '...' OR contains({text}, l))"


def redaction_java(rule: Redaction) -> str:
    flags = "U" + ("i" if rule.ignore_case else "") + ("s" if rule.dot_all else "")
    return f"{guard(rule.starts, rule.ignore_case)}(?{flags}){rule.body}"


def redact(text: str, rules: tuple[Redaction, ...] = REDACTIONS) -> str:
    """Replace secret shapes by marks; the rules run in their given order.

    Marks of a user's own rules must not hold literals of later ones. A rule runs only on a text that holds one of its literals. No mark contains a literal of a later
    rule, so looking at the text before all replacements is enough. The rules that remain are folded
    over the text: nine replacements inside each other would be tried one by one on every text. Each
    has an expression of its own, a literal, since Spark compiles one that changes from call to call anew.
    """
    def folded(t: str, low: str, odd: str) -> str:
        acc, rule_ = fresh("a"), fresh("r")
        steps, cases = [], []
        for i, rule in enumerate(rules):
            mark = ("$1" + rule.joint if rule.keeps_name else "") + rule.mark
            possible = contains_any(low, rule.needs) if rule.needs else "true"
            if rule.needs and rule.ignore_case:
                possible = f"({possible} OR {odd})"
            steps.append(when(possible, str(i)))
            cases.append(f"WHEN {i} THEN regexp_replace({acc}, {lit(redaction_java(rule))}, {lit(mark)})")
        if not steps:
            return t
        return (f"aggregate(array_compact(array({', '.join(steps)})), {t}, ({acc}, {rule_}) ->"
                f" CASE {rule_} {' '.join(cases)} ELSE {acc} END)")
    return let(text, lambda t: let(struct(low=f"lower({t})", odd=has_folding_letters(t)),
                                   lambda k: folded(t, f"{k}.low", f"{k}.odd")))


def fingerprint(rule_id: str, path: str, line: str, evidence: str) -> str:
    """Identity of a finding that survives moves of up to a few lines."""
    evidence_hash = f"substring(sha2(lower({strip(evidence)}), 256), 1, 16)"
    return (f"substring(sha2(concat_ws(':', {rule_id}, {path}, floor({line} / 5),"
            f" {evidence_hash}), 256), 1, 24)")


def snippet_id(path: str, start: str, end: str, text: str) -> str:
    return f"substring(sha2(concat_ws(':', {path}, {start}, {end}, sha2({text}, 256)), 256), 1, 16)"


def severity_rank(severity: str) -> str:
    cases = " ".join(f"WHEN {lit(name)} THEN {rank}" for rank, name in enumerate(SEVERITIES))
    return f"CASE {severity} {cases} END"


def sarif_level(severity: str) -> str:
    cases = " ".join(f"WHEN {lit(name)} THEN {lit(level)}" for name, level in SARIF_LEVELS.items())
    return f"CASE {severity} {cases} END"


def html_escape(text: str) -> str:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"),
                         ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {lit(raw)}, {lit(escaped)})"
    return text


def source_label(ref: str) -> str:
    start, end = f"{ref}.line_start", f"{ref}.line_end"
    return (
        f"CASE WHEN coalesce({start}, 0) != 0 AND coalesce({end}, 0) != 0"
        f" THEN concat({ref}.title, ' lines ', {start}, '-', {end})"
        f" WHEN coalesce({start}, 0) != 0 THEN concat({ref}.title, ' line ', {start})"
        f" ELSE {ref}.title END"
    )


def source_links(refs: str) -> str:
    links = each(refs, lambda r: f"concat('[', {source_label(r)}, '](', {r}.url, ')')")
    return f"array_join({links}, ', ')"
