"""What several steps need of a scan comes from one pass over the corpus."""

from checks import queries
from siftspark.operators import findings
from siftspark.options import ScanOptions
from siftspark.plans.scan import reviewed, scan_files
from siftspark.sources.catalog import built_in_catalog

TEXT = "# scan-disable-next-line LOG-003\nlogger.info(password)\nlogger.info(token)\n"


def read_again(df, name):
    return any("FileScan" in line and name in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_review_reads_the_corpus_once(spark, make_files, tmp_path):
    make_files(("a.py", TEXT), ("b.py", TEXT)).write.parquet(f"{tmp_path}/corpus")
    files = spark.read.parquet(f"{tmp_path}/corpus")
    answers = spark.createDataFrame([("r", "q", '{"findings":[{"rule_id":"LOG-001","path":"a.py","line":3,"message":"m",'
                                      '"evidence":"logger.info(token)","confidence":1.0}]}')],
                                    "repo string, request_id string, text string")
    result = scan_files(files, files.limit(0), built_in_catalog(spark), ScanOptions(block_mode="window"))
    after = reviewed(result, answers)
    assert not read_again(after.findings, "corpus") and not read_again(after.raw_findings, "corpus")
    got = sorted((r["path"], r["rule_id"], r["line"]) for r in after.findings.collect())
    own = sorted((r["path"], r["rule_id"], r["line"]) for r in findings.findings(files, ScanOptions(block_mode="window")).collect())
    assert got == sorted([*own, ("a.py", "LOG-001", 3)])


def test_evaluation_reads_the_corpus_once(spark):
    assert not read_again(queries.queries()["evaluate_by_rule"](spark, "/root/testdata/sf0.001"), "documents")
