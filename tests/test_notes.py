"""Notes of the scan, of its fallbacks and of the review."""

import json

from siftspark.operators import notes
from siftspark.options import ScanOptions
from siftspark.plans.scan import reviewed, scan, with_external
from siftspark.sources.catalog import built_in_catalog

RAW = "repo string, path string, length long, content binary"


def raw(spark, *files):
    return spark.createDataFrame([(r, p, len(c), c) for r, p, c in files], RAW)


FILES = (
    ("one", "a.py", b"try:\n    a()\nexcept E:\n    pass\n"),
    ("one", "b.java", b"  catch it\nint x;\n"),                 # a head of a window, no clause
    ("one", "c.py", b"x = \x00"), ("one", "d.py", b"# " + b"x" * 600 + b"\n"), ("one", "e.txt", b"no code"),
    ("two", "notes.md", b"text"), ("three", "build/x.py", b"x = 1\n"), ("three", "y.py", b"\x00"),
)


def test_notes_of_a_scan(spark):
    got = sorted(((r["repo"], r["stage"], r["path"], r["note"]) for r in notes.scan_notes(
        raw(spark, *FILES), ScanOptions(max_file_bytes=500)).collect()), key=str)
    assert got == sorted([
        ("one", "fallback", "b.java", "b.java: no exact block was found; line windows used."),
        ("one", "scan", "c.py", "c.py: skipped because it appears to be binary"),
        ("one", "scan", "d.py", "d.py: skipped because size exceeds 500 bytes"),
        ("three", "scan", "y.py", "y.py: skipped because it appears to be binary"),
        ("two", "scan", None, notes.NO_FILES), ("three", "scan", None, notes.NO_FILES)], key=str)
    windows = notes.scan_notes(raw(spark, *FILES), ScanOptions(block_mode="window"))
    assert windows.where("stage = 'fallback'").count() == 0
    assert notes.scan_notes(raw(spark, *FILES).where("false")).count() == 0


def test_notes_reach_the_reports(spark):
    result = scan(raw(spark, *FILES), built_in_catalog(spark), ScanOptions())
    parts = result.settled().reports()["json"].where("repo = 'one'").orderBy(
        "section", "rank", "path", "line", "rule_id", "seq", "fingerprint").collect()
    document = json.loads("".join(r["text"] for r in parts))
    assert notes.NO_REVIEW in document["notes"] and "b.java: no exact block was found; line windows used." in document["notes"]
    assert document["metrics"]["files_by_language"] == {"java": 1, "python": 2}


def test_notes_of_a_review(spark):
    result = scan(raw(spark, *FILES), built_in_catalog(spark), ScanOptions())
    answer = json.dumps({"findings": ["odd", {"rule_id": "NO-1", "path": "a.py", "line": 1, "message": "m", "evidence": "a", "confidence": 1}]})
    answers = spark.createDataFrame([("one", "q1", answer), ("one", "q2", "?")], "repo string, request_id string, text string")
    _, found = with_external(result, answers)
    review = sorted(r["note"] for r in found.where("stage = 'review'").collect())
    assert review == ["Semantic analysis response was not valid JSON.", "Semantic finding rejected: unknown rule_id NO-1",
                      "Semantic finding skipped because it was not an object."]
    assert found.where("stage = 'scan'").count() > 0


def test_gate_and_reports_after_a_review(spark):
    files = [("one", "a.py", b"import logging\ntoken = read()\nlogging.info(token)\n")]
    raw_files = raw(spark, *files)
    options = ScanOptions(fail_on_severity="low")
    result = scan(raw_files, built_in_catalog(spark), options)
    before = {r["rule_id"] for r in result.findings.collect()}
    answer = json.dumps({"findings": [{
        "rule_id": "LOG-001", "path": "a.py", "line": 2, "message": "m", "evidence": "token = read()", "confidence": 0.9,
        "severity": "low", "recommendation": "Do it."}, "odd"]})
    after = reviewed(result, spark.createDataFrame([("one", "q1", answer)], "repo string, request_id string, text string")).settled()
    found = [r for r in after.findings.collect() if r["analyzer"] == "semantic"]
    assert [(r["rule_id"], r["line"]) for r in found] == [("LOG-001", 2)]
    assert before <= {r["rule_id"] for r in after.findings.collect()}
    assert [r["exit_code"] for r in after.gate().collect()] == [r["exit_code"] for r in after.gate(processed=False).collect()] == [1]
    reports = after.reports()
    order = ["section", "rank", "path", "line", "rule_id", "seq", "fingerprint"]
    document = json.loads("".join(r["text"] for r in reports["json"].orderBy(*order).collect()))
    assert document["summary"]["semantic_enabled"] is True and document["summary"]["findings"] == after.findings.count()
    assert notes.NO_REVIEW not in document["notes"]
    assert "Semantic finding skipped because it was not an object." in document["notes"]
    assert "Do it." in [x["recommendation"] for x in document["findings"]]
    assert "LOG-001" in "".join(r["text"] for r in reports["markdown"].collect())
