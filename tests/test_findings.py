import hashlib

from pyspark.sql import functions as F

from siftspark.operators import findings
from siftspark.options import ScanOptions
from siftspark.sources.catalog import built_in_catalog
from tests.test_rules import JAVA_SAMPLE, PY_SAMPLE

OPTIONS = ScanOptions(directive="sift")


def test_next_line_suppression(make_files):
    files = make_files(("a.py", "# sift-disable-next-line LOG-003\nlogging.info('password')\n"))
    assert findings.raw_findings(files, OPTIONS).count() == 1
    assert findings.findings(files, OPTIONS).count() == 0


def test_file_suppression_wins_over_line(make_files):
    text = ("logging.info('password')\nlogging.info('secret')\n# sift-disable-file LOG-003\n"
            "# sift-disable-next-line LOG-003\nx\n")
    assert findings.findings(make_files(("a.py", text)), OPTIONS).count() == 0


def test_suppression_is_per_rule_and_line(make_files):
    text = ("# sift-disable-next-line LOG-004\nlogging.info('password')\n"
            "logging.info('token')\n")
    rows = findings.findings(make_files(("a.py", text)), OPTIONS).collect()
    assert sorted((r.rule_id, r.line) for r in rows) == [("LOG-003", 2), ("LOG-003", 3)]


def test_fingerprint_formula(make_files):
    row = findings.findings(make_files(("a.py", "\nlogging.info('Password')\n")), OPTIONS).head()
    evidence = hashlib.sha256(b"logging.info('password')").hexdigest()[:16]
    raw = f"LOG-003:a.py:{2 // 5}:{evidence}"
    assert row.fingerprint == hashlib.sha256(raw.encode()).hexdigest()[:24]


def test_same_line_twice_in_a_bucket_is_one_finding(make_files):
    files = make_files(("a.py", "logging.info(password)\n" * 7))
    assert findings.raw_findings(files, OPTIONS).count() == 7
    assert [r.line for r in findings.findings(files, OPTIONS).collect()] == [1, 5]


def test_table_steps_equal_row_steps(make_files):
    files = make_files(("a.py", PY_SAMPLE), ("b.py", PY_SAMPLE * 4), ("A.java", JAVA_SAMPLE * 3))
    own = findings.findings(files, OPTIONS)
    table = findings.fingerprint_dedupe(findings.suppress(
        findings.dedupe_candidates(findings.candidates(files, OPTIONS)),
        findings.suppressions(files, OPTIONS)))
    keys = ["path", "rule_id", "line", "message", "evidence", "fingerprint", "seq"]
    assert sorted(own.select(keys).collect()) == sorted(table.select(keys).collect())


def test_result_does_not_depend_on_partitions(make_files):
    files = make_files(*[(f"d{i}.py", PY_SAMPLE) for i in range(20)])
    keys = ["path", "rule_id", "line", "fingerprint"]
    one = findings.findings(files.repartition(1), OPTIONS).select(keys).collect()
    many = findings.findings(files.repartition(13), OPTIONS).select(keys).collect()
    assert sorted(one) == sorted(many)


def test_keep_first_of_a_hot_key(spark):
    hot = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 'hot', concat('k', id)) AS k", "20000 - id AS o", "id AS v")
    kept = findings.keep_first(hot, ("k",), ("o",))
    assert kept.where("k = 'hot'").collect()[0].v == 19_998
    assert kept.count() == hot.select("k").distinct().count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") == 1     # copies collapse before the exchange


def test_scan_has_no_exchange(make_files, spark):
    found = findings.findings(make_files(("a.py", PY_SAMPLE)), OPTIONS)
    plan = findings.enrich(found, built_in_catalog(spark))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text
    assert text.count("ArrowEvalPython") == 0 and text.count("Generate inline") <= 2


def test_catalog_decides_severity_and_order(make_files, spark):
    found = findings.enrich(findings.findings(make_files(
        ("b.py", PY_SAMPLE), ("A.java", JAVA_SAMPLE)), OPTIONS), built_in_catalog(spark))
    rows = findings.ordered(found).collect()
    ranks = [["critical", "high", "medium", "low", "info"].index(r.severity) for r in rows]
    assert ranks == sorted(ranks)
    places = [(k, r.path, r.line, r.rule_id) for k, r in zip(ranks, rows)]
    assert places == sorted(places)
    assert {r.severity for r in rows if r.rule_id == "ERR-003"} == {"medium"}
    assert found.where(F.size("source_refs") == 0).count() == 0
