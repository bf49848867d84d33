import json
from pathlib import Path

from siftspark.operators import exports, findings, metrics
from siftspark.options import ScanOptions
from siftspark.plans.scan import scan_files
from siftspark.sources.catalog import built_in_catalog
from siftspark.streaming import stream
from tests.test_rules import JAVA_SAMPLE, PY_SAMPLE

LEAK = "password = 'secret-value'  # logger.info\n"


def sample(spark):
    rows = [("one", "a.py", "python", PY_SAMPLE), ("one", "A.java", "java", JAVA_SAMPLE),
            ("one", "b.py", "python", "logger.info(\"password='secret-value' <b>\")\n"),
            ("two", "ok.py", "python", "x = 1\n")]
    files = spark.createDataFrame(rows, "repo string, path string, language string, text string")
    skipped = spark.createDataFrame([("one", "z.py", "binary", 'z.py: "binary"')],
                                    "repo string, path string, reason string, note string")
    return scan_files(files, skipped, built_in_catalog(spark), ScanOptions())


def documents(folder):
    return {d.name.split("=")[1]: "".join(p.read_text() for p in sorted(d.glob("part-*")))
            for d in Path(folder).iterdir() if d.is_dir() and "=" in d.name}


def test_written_reports(spark, tmp_path):
    notes = spark.createDataFrame([("one", "first note"), ("one", 'second "note"'), ("one", "first note")],
                                  "repo string, note string")
    reports = sample(spark).settled().reports(notes)
    paths = exports.write_exports(reports, str(tmp_path), ("json", "SARIF ", "markdown", "html", "x"))
    assert set(paths) == {"json", "sarif", "markdown", "html"}

    docs = documents(paths["json"])
    one, two = json.loads(docs["one"]), json.loads(docs["two"])
    assert one["summary"]["findings"] == len(one["findings"]) == 11 and two["findings"] == []
    assert one["notes"] == ["first note", "first note", 'second "note"'] and one["skipped"] == ['z.py: "binary"']
    assert [r["id"] for r in one["rules"]][0] == "ERR-001" and len(one["rules"]) == 10
    assert one["summary"]["findings_by_severity"] == {"high": 7, "medium": 4}
    assert "secret-value" not in docs["one"] and one["metrics"]["total_loc"] == 55
    ranks = [["critical", "high", "medium"].index(f["severity"]) for f in one["findings"]]
    assert ranks == sorted(ranks)

    sarif = json.loads(documents(paths["sarif"])["one"])
    assert sarif["version"] == "2.1.0"
    results = sarif["runs"][0]["results"]
    assert len(results) == 11 and {r["level"] for r in results} == {"error", "warning"}
    assert all(r["partialFingerprints"]["primaryLocationLineHash"] for r in results)
    assert len(sarif["runs"][0]["tool"]["driver"]["rules"]) == 10

    markdown = documents(paths["markdown"])
    assert markdown["one"].startswith("# ") and "## Rule Catalog" in markdown["one"]
    assert "- High: `7`" in markdown["one"] and "- Low: `0`" in markdown["one"]
    assert "No findings were detected" in markdown["two"] and "secret-value" not in markdown["one"]
    order = [markdown["one"].index(h) for h in (
        "## Notes", "## Summary", "## Findings", "### HIGH", "### MEDIUM", "## Rule Catalog",
        "## Skipped Files")]
    assert order == sorted(order)

    html = documents(paths["html"])
    assert html["one"].count("<section>") == 11 and "&lt;b&gt;" in html["one"]
    assert html["one"].endswith("</html>\n") and "secret-value" not in html["one"]
    assert "No findings were detected" in html["two"]


def test_parquet_sink(spark, tmp_path):
    result = sample(spark)
    exports.write_findings(result.findings, str(tmp_path / "f"))
    back = spark.read.parquet(str(tmp_path / "f"))
    assert back.count() == 11 and {r.repo for r in back.select("repo").distinct().collect()} == {"one"}


def test_summary_and_gate(spark):
    result = sample(spark)
    rows = {r.repo: r for r in result.summary().collect()}
    assert (rows["one"].files_scanned, rows["one"].findings, rows["one"].skipped_files) == (3, 11, 1)
    assert rows["two"].findings == 0
    for threshold, expected in (("high", {"one": 1, "two": 0}), ("critical", {"one": 0, "two": 0}),
                                ("bogus", {"one": 2, "two": 2}), (None, {"one": 0, "two": 0})):
        gate = metrics.severity_gate(result.findings, result.files, threshold)
        assert {r.repo: r.exit_code for r in gate.collect()} == expected


def test_evaluation(spark):
    result = sample(spark)
    found = findings.checked_findings(result.files).selectExpr("*", "path AS case")
    wanted = found.where("path = 'a.py'").select("case", "rule_id", "line").unionByName(
        spark.createDataFrame([("a.py", "LOG-001", 1)], "case string, rule_id string, line int"))
    row = metrics.evaluate(found, wanted, result.files).head()
    assert (row.expected_total, row.matched_total, row.recall) == (5, 4, 0.8)
    assert row.precision == round(4 / 11, 4) and row.rule_coverage == 0.75
    assert row.evidence_validity == 1.0 and row.findings_per_kloc == 196.43
    empty = metrics.evaluate(found.limit(0), wanted.limit(0), result.files).head()
    assert (empty.precision, empty.recall, empty.f1, empty.false_positive_rate) == (1.0, 1.0, 1.0, 0.0)


def test_stream_equals_batch(spark, tmp_path):
    schema = "repo string, path string, length long, content binary"
    rows = [("r", f"d{i}.py", len(PY_SAMPLE), PY_SAMPLE.encode()) for i in range(6)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    found = stream.stream_findings(raw)
    for _ in range(2):   # a second run finds nothing new
        query = stream.run_available(found, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 * 4 and out.select("fingerprint").distinct().count() == 6 * 4


def test_severities_of_a_repo_without_findings(spark):
    found = spark.createDataFrame([("one", "high")], "repo string, severity string")
    repos = spark.createDataFrame([("one",), ("two",), ("two",)], "repo string")
    rows = metrics.by_severity_filled(found, repos).collect()
    assert len(rows) == 10 and sum(r.findings for r in rows if r.repo == "two") == 0


def test_every_line_of_the_evidence_counts(spark):
    files = spark.createDataFrame([("r", "a.py", "x = 1\ny = 2\n")], "repo string, path string, text string")
    found = spark.createDataFrame(
        [("r", "a.py", k, e) for k, e in enumerate(("x = 1\ny = 2\n...", "x = 1\ny = 3", "y = 2"))],
        "repo string, path string, k int, evidence string")
    rows = metrics.with_evidence_check(found, files).collect()
    assert {r.k: r.evidence_valid for r in rows} == {0: True, 1: False, 2: True}


def test_results_are_written_without_a_setting(spark):
    from siftspark.sources.landing import landed, shared_folder
    assert landed(spark.range(5)).count() == 5 and shared_folder(spark)


def test_reports_scan_the_corpus_once(spark, monkeypatch):
    from checks import queries
    from siftspark.operators import findings, metrics
    calls = []

    def counted(*args, **options):
        calls.append(1)
        return findings_array(*args, **options)
    findings_array = findings.deduped_array
    monkeypatch.setattr(findings, "deduped_array", counted)
    monkeypatch.setattr(metrics, "deduped_array", counted)
    for kind in ("json", "sarif", "markdown", "html"):
        calls.clear()
        assert queries._report(kind)(spark, "/root/testdata/sf0.001").count() > 0
        assert len(calls) == 1


def test_findings_and_summary_of_one_pass(spark, make_files):
    from siftspark.operators import findings, metrics
    files = make_files(("a.py", "logger.info(password)\ntry:\n    x()\nexcept Exception:\n    pass\n"), ("b.java", ""),
                       ("c.java", "// scan-disable-file LOG-003\nlogger.info(token);\nSystem.out.println(password);"))
    once = metrics.scanned(files).cache()
    assert findings.found_in(once).exceptAll(findings.findings(files)).count() == 0
    assert findings.found_in(once).count() == findings.findings(files).count() > 0
    assert metrics.summary_of(once).collect() == metrics.scan_summary(files).collect()
