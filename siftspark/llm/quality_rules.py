"""Quality rules: a decision list learned by sequential covering, run as Spark conditional expressions.

Statistics of a text are built-in expressions over its own row, so nothing is shuffled. From a bounded
sample of labelled rows' statistics the learner grows one rule at a time: a conjunction of thresholds, each
chosen for the greatest information gain on two thirds of what is left, then pruned on the other third.
A rule that is not precise enough there ends the list. Rules are tried in the order learned; what none
matches is kept. A learned list can be read, stored and applied as it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.sql import let

MAX_ROWS = 6_000
MAX_RULES = 12
MAX_CONDITIONS = 3
MIN_PRECISION = 0.9
MIN_COVER = 3
_CUTS = 48  # thresholds tried for a feature

BREAKS = r"r'[\x20\x09-\x0D]+'"


def words(text: str) -> str:
    """SQL: the words of a text, an array of strings."""
    return f"filter(split({text}, {BREAKS}), w -> w <> '')"


def _repeated(ws: str) -> str:
    """SQL: the number of words in 3-word windows that occur twice or more. Sorting keeps it n log n."""
    hashed = (f"sort_array(transform(sequence(0, size({ws}) - 3), i -> named_struct("
              f"'h', xxhash64({ws}[i], {ws}[i + 1], {ws}[i + 2]), 'i', i)))")
    count = let(hashed, lambda s: (
        f"size(array_distinct(flatten(transform(filter(transform({s}, (e, k) -> "
        f"if(e.h = get({s}, k - 1).h OR e.h = get({s}, k + 1).h, e.i, NULL)), e -> e IS NOT NULL),"
        f" e -> array(e, e + 1, e + 2)))))"))
    return f"if(size({ws}) < 3, 0, {count})"


def _lines(text: str) -> str:
    return f"filter(split({text}, r'\\n'), l -> l rlike r'[^\\x20\\x09-\\x0D]')"


def _kept(text: str, chars: str) -> str:
    """SQL: how many characters of a class a text has."""
    return f"char_length(regexp_replace({text}, r'[^{chars}]+', ''))"


def statistics(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", *more: str) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_lines)."""
    of_words = let(words("text"), lambda ws: (
        f"named_struct('n', cast(size({ws}) AS bigint), 'repeat', cast({_repeated(ws)} AS bigint))"))
    of_lines = let(_lines("text"), lambda ls: (
        f"named_struct('n', cast(size({ls}) AS bigint), 'dup', cast(size({ls}) - size(array_distinct({ls})) AS bigint))"))
    row = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text", *more)
    parts = row.selectExpr(
        "id", *more, f"{of_words} AS w", f"{of_lines} AS l",
        f"cast(char_length(regexp_replace(text, {BREAKS}, '')) AS bigint) AS word_chars",
        f"cast({_kept('text', '#*$%&|<>')} AS bigint) AS n_symbols",
        f"cast({_kept('text', 'A-Z')} AS bigint) AS n_upper",
        f"cast({_kept('text', '!?.,;:')} AS bigint) AS n_marks")
    # inline() takes both structs apart at once; a plain field access would copy the expression per field
    return parts.selectExpr("id", *more, "word_chars", "n_symbols", "n_upper", "n_marks", "l", "inline(array(w))").selectExpr(
        "id", *more, "word_chars", "n_symbols", "n_upper", "n_marks", "n AS n_words", "repeat AS n_repeat_words",
        "inline(array(l))").selectExpr(
        f"id AS `{id_col}`", *more, "n_words", "word_chars", "n_symbols", "dup AS n_dup_lines", "n_repeat_words",
        "n_upper", "n_marks", "n AS n_lines")


# Features that rules may test, as SQL over the statistics.
FEATURES = {
    "n_words": "cast(n_words AS double)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
    "line_length": "n_words / greatest(n_lines, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.feature] > self.threshold) == self.above


Rule = tuple[Condition, ...]


def matches(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def _counts(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> tuple[int, int]:
    """(bad rows, good rows) that a rule matches."""
    bad = [is_bad for row, is_bad in rows if matches(rule, row)]
    return sum(bad), len(bad) - sum(bad)


def _grow(rows: list[tuple[dict[str, float], bool]]) -> Rule:
    rule: Rule = ()
    inside = rows
    while len(rule) < MAX_CONDITIONS:
        bad = sum(b for _, b in inside)
        good = len(inside) - bad
        if not bad or not good:
            break
        base, best = math.log2(bad / (bad + good)), (0.0, None)
        for name in FEATURES:
            ordered = sorted((row[name], b) for row, b in inside)
            below_bad = below_good = 0
            last_cut = -1
            for k, (value, b) in enumerate(ordered[:-1]):
                below_bad, below_good = below_bad + b, below_good + (not b)
                cut = k * _CUTS // len(ordered)
                following = ordered[k + 1][0]
                # Quantile steps, and any step at the rim, where a few rows may be all of one kind.
                if following == value or (cut == last_cut and MIN_COVER < k < len(ordered) - MIN_COVER):
                    continue
                last_cut = cut
                for above, p, n in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    if p >= MIN_COVER:
                        gain = p * (math.log2(p / (p + n)) - base)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, (value + following) / 2))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        inside = [(row, b) for row, b in inside if best[1].holds(row)]
    return rule


def _pruned(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> Rule:
    """The leading conditions that do best on rows not used for growing."""
    def worth(r: Rule) -> float:
        p, n = _counts(r, rows)
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())


def learned(rows: list[tuple[dict[str, float], bool]]) -> list[Rule]:
    """Ordered rules that tell bad rows; ``rows`` are (features, is bad) in an order free of the label."""
    left, rules = rows, []
    while len(rules) < MAX_RULES and any(b for _, b in left):
        grow = [r for k, r in enumerate(left) if k % 3]
        prune = [r for k, r in enumerate(left) if k % 3 == 0]
        rule = _pruned(_grow(grow), prune)
        bad, good = _counts(rule, left) if rule else (0, 1)
        p, n = _counts(rule, prune) if rule else (0, 1)
        if bad < MIN_COVER or bad < MIN_PRECISION * (bad + good) or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        left = [(row, b) for row, b in left if not matches(rule, row)]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Kept or not over the columns of ``statistics``: the first rule that matches decides."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        test = F.expr(" AND ".join(c.sql() for c in rule))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return out.otherwise(F.lit(True))


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def fitted(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS,
) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled rows (1 good, 0 bad) that pass the base filter.

    The sample is taken by the smallest hash of the id; its ids are bounded and so are broadcast. Only its
    statistics, a few numbers a row, go to the driver.
    """
    chosen = F.broadcast(
        labels.selectExpr(f"`{id_col}` AS label_id", f"`{label_col}` AS label")
        .filter("label IN (0, 1) AND label_id IS NOT NULL").groupBy("label_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows))
    rows = docs.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text").join(
        chosen, F.col("id") == F.col("label_id")).select("id", "text", "label")
    found = (
        statistics(rows, "text", "id", "label").filter(f"NOT ({BASE_FAILED})")
        .selectExpr("label", "xxhash64(id) AS place", *(f"{sql} AS {name}" for name, sql in FEATURES.items()))
        .collect()
    )
    ordered = sorted(found, key=lambda r: tuple(r))
    ordered.sort(key=lambda r: r["place"])
    return learned([({n: float(r[n]) for n in FEATURES}, r["label"] == 0) for r in ordered])


def judged(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept).

    Null and empty texts have no words and fail the base filter. Rows that repeat are judged each; null ids
    stay null; other columns are ignored; an empty table gives an empty result.
    """
    found = statistics(docs, text_col, id_col)
    failed = F.expr(BASE_FAILED)
    return found.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
