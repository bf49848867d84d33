"""State of streams across batches, restarts and repeated batches."""

from checks import queries
from siftspark.streaming import stream

FINDING = "repo string, fingerprint string, rule_id string"


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, FINDING).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(FINDING).option("maxFilesPerTrigger", 1).parquet(folder)


def test_first_seen_survives_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in ([("r", "a", "x"), ("r", "b", "x"), ("r", "a", "x")], [("r", "b", "y"), ("s", "b", "y"), ("r", None, "y")],
                 [("r", None, "z"), ("r", "c", "z")]):
        stream.run_available(stream.first_seen(deliver(spark, folder, rows)), out, state).awaitTermination()
    got = sorted(((r["repo"], r["fingerprint"]) for r in spark.read.parquet(out).collect()), key=str)
    assert got == sorted([("r", "a"), ("r", "b"), ("s", "b"), ("r", None), ("r", "c")], key=str)


def test_counts_go_on_after_a_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    keys = ("repo", "rule_id")
    for rows in ([("r", "a", "x"), ("r", "b", "x")], [("r", "c", "x"), ("s", "d", "y")]):
        stream.run_counts(deliver(spark, folder, rows), keys, out, state).awaitTermination()
    # A third start finds nothing new and changes nothing.
    again = spark.readStream.schema(FINDING).parquet(folder)
    stream.run_counts(again, keys, out, state).awaitTermination()
    got = {tuple(r) for r in stream.latest_counts(spark, out, keys).collect()}
    assert got == {("r", "x", 3), ("s", "y", 1)}


def test_new_files(spark, tmp_path):
    schema = "path string, file_hash string"
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    seen = spark.createDataFrame([("h0",)], "file_hash string")
    for rows in ([("a", "h0"), ("b", "h1")], [("c", "h1"), ("d", "h2")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        files = spark.readStream.schema(schema).parquet(folder)
        stream.run_available(stream.new_files(files, seen), out, state).awaitTermination()
    assert sorted(r["path"] for r in spark.read.parquet(out).collect()) == ["b", "d"]
    # Without an earlier scan, a batch table works as well.
    assert stream.new_files(spark.createDataFrame([("a", "h"), ("b", "h")], schema)).count() == 1


def test_delivered_files_are_derived_once_and_read_in_parts(spark, tmp_path):
    raw = queries._raw_corpus(spark, "/root/testdata/sf0.01")
    seen = []

    def start(arrived):
        plan = queries._streamed_findings(spark.read.parquet(f"{tmp_path}/arrived"))._jdf.queryExecution().optimizedPlan().toString()
        seen.append(plan.count("split(replace("))
        return stream.run_available(arrived.select("path"), f"{tmp_path}/out", f"{tmp_path}/state")
    queries._delivered_twice(raw, "path", str(tmp_path), start)
    assert seen == [0, 0]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 * raw.count()
