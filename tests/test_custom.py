"""Rules, redactions, languages and analyzers of a user's own."""

import re

import pytest

from siftspark.functions import patterns as P
from siftspark.functions import text as T
from siftspark.operators import findings
from siftspark.operators.rules import Emission, Rule, read_redactions, read_rules
from siftspark.options import ScanOptions
from siftspark.sources import files as S

RULES = ("ord int, rule_id string, scope string, languages array<string>, must array<string>, must_not array<string>,"
         " needs array<string>, message string, confidence double, signals array<string>, skip_comments boolean")


def rule(ord_, rule_id, scope, must, must_not=None, needs=None, languages=None, skip=False):
    return (ord_, rule_id, scope, languages, must, must_not, needs, f"message of {rule_id}", 0.5, None, skip)


def hits(spark, make_files, rules, *items, **options):
    own = read_rules(spark.createDataFrame(rules, RULES))
    found = findings.raw_findings(make_files(*items), ScanOptions(custom_rules=own, **options))
    return sorted((r["path"], r["rule_id"], r["line"]) for r in found.collect() if r["rule_id"].startswith("X-"))


def test_rules_of_a_table(spark, make_files):
    rules = [
        rule(2, "X-2", "line", ["todo", "[0-9]+"], ["wont"], ["todo"]),
        rule(1, "X-1", "line", ["^import"], languages=["python"]),
        rule(3, "X-3", "block", [], ["logger"]),            # no expression must hold: every block without one
        rule(4, "X-4", "line", ["note"], skip=True),
        rule(5, "X-5", "line", ["straße"], needs=["straße"]),
    ]
    text = "import os\nx = 1  # TODO 7\n# todo 8 wont\n# a note\nnote = 2  # STRASSE Straße\ntry:\n    a()\nexcept E:\n    pass\n"
    got = hits(spark, make_files, rules, ("a.py", text), ("A.java", "import x;\n// todo 9\n"), ("b.py", ""))
    assert got == [("A.java", "X-2", 2), ("a.py", "X-1", 1), ("a.py", "X-2", 2), ("a.py", "X-3", 8), ("a.py", "X-4", 5), ("a.py", "X-5", 5)]


def test_more_rules_than_a_mask_has_bits(spark, make_files):
    rules = [rule(k, f"X-{k}", "line", [f"word{k}[.]"], needs=[f"word{k}."]) for k in range(300)]
    text = "\n".join(f"say word{k}. and word{(k * 7) % 300}." for k in range(0, 300, 3))
    got = hits(spark, make_files, rules, ("a.py", text + "\nlogger.info(password)\n"))
    want = {(f"X-{k}", k // 3 + 1) for k in range(0, 300, 3)} | {(f"X-{(k * 7) % 300}", k // 3 + 1) for k in range(0, 300, 3)}
    assert {(r, n) for _, r, n in got} == want
    # The built-in rules and the order of emission stay.
    own = read_rules(spark.createDataFrame(rules, RULES))
    files = make_files(("a.py", "logger.info(password)  # word5.\n"))
    found = findings.candidates(files, ScanOptions(custom_rules=own)).orderBy("seq").collect()
    assert [r["rule_id"] for r in found] == ["LOG-003", "X-5"]


def test_suppression_reaches_custom_rules(spark, make_files):
    own = (Emission(Rule("CUS-9", "line", (P.Pattern("n", "needle", ("needle",)),), (), "found", 0.9, ()), ("python",), 4),)
    files = make_files(("a.py", "# scan-disable-next-line CUS-9\nneedle\nneedle 2\n"))
    found = findings.findings(files, ScanOptions(custom_rules=own)).collect()
    assert [(r["rule_id"], r["line"]) for r in found] == [("CUS-9", 3)]


def test_unknown_scope(spark):
    with pytest.raises(ValueError):
        read_rules(spark.createDataFrame([rule(1, "X-1", "file", ["a"])], RULES))


def test_redactions_of_a_table(spark):
    rows = [(2, "b+", "<b>", None), (1, "secret [a-z]+", "<s>", ["secret"])]
    own = read_redactions(spark.createDataFrame(rows, "ord int, body string, mark string, needs array<string>"))
    texts = spark.createDataFrame([("SECRET abb bb",), ("password=x",), (None,)], "text string")
    assert [r[0] for r in texts.selectExpr(T.redact("text", own)).collect()] == ["<s> <b>", "password=x", None]
    assert [r[0] for r in texts.selectExpr(T.redact("text", ())).collect()] == ["SECRET abb bb", "password=x", None]


def test_languages_of_a_table(spark, tmp_path):
    for name in ("a.py", "b.KT", "c.java", "d.txt"):
        (tmp_path / name).write_text("x\n")
    options = ScanOptions(suffixes=((".kt", "kotlin"), (".py", "python")), languages_include=("kotlin", "python"))
    files = S.collect_files(S.read_directory(spark, str(tmp_path), "r", options), options)
    assert sorted((r["path"], r["language"]) for r in files.collect()) == [("a.py", "python"), ("b.KT", "kotlin")]


def test_analyzers_of_a_user(spark, make_files):
    def long_lines(lines, blocks):
        return lines.where("length(text) > 30").selectExpr(
            "repo", "path", "language", "'OWN-7' AS rule_id", "line", "'long' AS message", "text AS evidence", "1 AS confidence",
            "array('length') AS signals")
    files = make_files(("a.py", "x" * 40 + "\n# scan-disable-next-line OWN-7\n" + "y" * 40 + "\nlogger.info(password)\n"))
    found = findings.analyzed(files, (long_lines, long_lines)).collect()
    assert sorted((r["rule_id"], r["line"]) for r in found) == [("LOG-003", 4), ("OWN-7", 1)]
    assert findings.analyzed(files.where("false"), (long_lines,)).count() == 0


def test_each_redaction_is_a_literal_of_its_own():
    """An expression that comes from a variable is compiled anew whenever it differs from the last one."""
    said = T.redact("text")
    assert len(re.findall(r"regexp_replace\(\w+, '", said)) == said.count("regexp_replace(") == len(P.REDACTIONS)


def test_what_many_rules_share_is_tested_once(spark, make_files):
    """Rules behind a shared expression, a shared exception, both or neither, in lines and blocks, against a plain loop."""
    words = [f"w{a}{b}" for a in "abc" for b in "abcd"]
    rules, k = [], 0
    for scope in ("line", "block"):
        for must, must_not, skip in ((["call[(]"], [], True), (["call[(]"], ["never"], False), ([], ["never"], False), ([], [], True)):
            for at, word in enumerate(words if must else words[:9]):
                rules.append(rule(k, f"X-{k}", scope, [f"{word}[!.]", *must], must_not, [word] if at % 2 else None,
                                  ["python"] if at == 3 else None, skip))
                k += 1
    lines = [f"{'# ' if n % 5 == 0 else ''}{'call(' if n % 3 else ''}{words[n % 12]}{'!.?'[n % 4 % 3]} {words[n * 7 % 12]}."
             f"{' never' if n % 7 == 0 else ''}" for n in range(60)]
    lines[10], lines[40] = "except E:", "} catch (E e) {"
    body = "\n".join(lines)
    want = []
    for path, language in (("a.py", "python"), ("B.java", "java")):
        blocks = [(at + 1, "\n".join(lines[at:at + 14])) for at in (10, 40)]
        for _, rule_id, scope, languages, must, must_not, _, _, _, _, skip in rules:
            for line, text in blocks if scope == "block" else enumerate(lines, 1):
                if (language in (languages or (language,)) and all(re.search(p, text) for p in must)
                        and not any(re.search(p, text) for p in must_not) and not (skip and re.match(r"\s*(#|//|\*|$)", text))):
                    want.append((path, rule_id, line))
    assert hits(spark, make_files, rules, ("a.py", body), ("B.java", body), block_mode="window") == sorted(want) and len(want) > 300
    own = read_rules(spark.createDataFrame(rules, RULES))
    text = findings.candidate_array(ScanOptions(custom_rules=own, block_mode="window"))
    assert text.count(P.Pattern("", "call[(]").java.replace("\\", "\\\\")) <= 4       # one a gate
