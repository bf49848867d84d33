"""The registered queries: every operator over whole tables or a corpus derived from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from checks.corpus import as_code, code_files, table
from siftspark.functions import patterns as P
from siftspark.functions import text as T
from siftspark.operators import exchange, exports, external, extract, findings, metrics, notes, snippets
from siftspark.operators.rules import Rule, read_redactions, read_rules
from siftspark.options import ScanOptions
from siftspark.plans.scan import reviewed, scan_files, with_external
from siftspark.sources import files as S
from siftspark.sources.catalog import built_in_catalog
from siftspark.sources.landing import bucketed, landed, run_folder
from siftspark.streaming import stream

WINDOW = ScanOptions(block_mode="window")
SCOPED = ScanOptions(block_mode="scoped")
RAW_OPTIONS = ScanOptions(max_file_bytes=30_000)
FILE_LIMIT = 50
Query = Callable[[SparkSession, str], DataFrame]


def big(df: DataFrame) -> DataFrame:
    """Integers as bigint and string lists as text, so both engines name one type."""
    columns = []
    for field in df.schema:
        kind = field.dataType
        if isinstance(kind, (ST.IntegerType, ST.ShortType)):
            columns.append(F.col(field.name).cast("bigint").alias(field.name))
        elif isinstance(kind, ST.ArrayType) and isinstance(kind.elementType, ST.StringType):
            columns.append(F.array_join(field.name, ",").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(*columns)


# ------------------------------------------------------------------------------------------ inputs

def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw files in varied folders, some of them ignored, foreign or binary."""
    docs = table(spark, sf_dir, "documents")
    return docs.selectExpr(
        "source AS repo",
        "concat(CASE doc_id % 7 WHEN 0 THEN 'build/out/' WHEN 1 THEN 'app/.venv/lib/'"
        " WHEN 2 THEN 'legacy/' ELSE 'src/main/' END, 'd', doc_id,"
        " CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.PY'"
        " WHEN 3 THEN '.txt' ELSE '.java' END) AS path",
        "CASE WHEN doc_id % 13 = 0 THEN concat(X'00', encode(text, 'UTF-8'))"
        " ELSE encode(text, 'UTF-8') END AS content",
    ).selectExpr("repo", "path", "cast(length(content) AS bigint) AS length", "content")


RAW_GLOBS = (*ScanOptions().default_ignores, "legacy/", "d77*.py")


def notes_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text of three tables, for functions on text."""
    docs = table(spark, sf_dir, "documents").selectExpr("'documents' AS origin", "doc_id AS id",
                                                        "0L AS part", "text")
    pages = table(spark, sf_dir, "pages").selectExpr("'pages' AS origin", "page_id AS id",
                                                     "0L AS part", "html AS text")
    talks = table(spark, sf_dir, "conversations").selectExpr(
        "'conversations' AS origin", "conv_id AS id", "turn AS part", "text")
    return docs.unionByName(pages).unionByName(talks)


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One secret shape per customer, nine shapes in turn."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "concat(CASE c_custkey % 9"
        " WHEN 0 THEN 'password = \"hunter2-'"
        " WHEN 1 THEN 'api_key: '"
        " WHEN 2 THEN 'Authorization: Basic '"
        " WHEN 3 THEN 'session-id='"
        " WHEN 4 THEN 'eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.abcdefghijklmno '"
        " WHEN 5 THEN 'bearer abcdefghijklmnop.qrst '"
        " WHEN 6 THEN 'jdbc:postgresql://host/db?user='"
        " WHEN 7 THEN '-----BEGIN RSA PRIVATE KEY-----\\nabc\\n-----END RSA PRIVATE KEY----- '"
        " ELSE 'card 4111-1111 1111 1111 ' END, c_name, ', ', c_nationkey) AS text")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per file of the corpus, ten kinds in turn: good, wrong in one way, or no JSON. One kind
    repeats a finding of the scan's own, the first of the file."""
    files = code_files(spark, sf_dir)
    kind = "(cast(regexp_extract(path, '[0-9]+', 0) AS bigint) % 10)"
    # Only answers of kind 9 name a finding of the scan's own.
    own = findings.raw_findings(files.where(f"{kind} = 9"), WINDOW).groupBy("repo", "path").agg(
        F.min(F.struct("line", "rule_id")).alias("own"))
    item = (
        "concat('{\"rule_id\":\"', CASE WHEN k = 1 THEN 'XXX-9' WHEN k = 9 THEN coalesce(own.rule_id, 'LOG-001')"
        " ELSE 'LOG-001' END,"
        " '\",\"path\":\"', CASE WHEN k = 2 THEN 'no/such.py' ELSE path END,"
        " '\",\"line\":', CASE WHEN k = 3 THEN '99999' WHEN k = 0 THEN '\"1\"'"
        " WHEN k = 9 THEN string(coalesce(own.line, 1)) ELSE '1' END,"
        " ',\"message\":', CASE WHEN k = 4 THEN 'null' ELSE '\" odd \"' END,"
        " ',\"evidence\":\"', CASE WHEN k = 5 THEN 'zzz-not-there' WHEN k = 8 THEN '' ELSE first_word END,"
        " '\",\"confidence\":', CASE WHEN k = 6 THEN '0.5' ELSE '1.5' END, '}')"
    )
    words = files.selectExpr("repo", "path", f"{kind} AS k", "regexp_extract(text, '[a-z]+', 0) AS first_word")
    return words.join(own, ["repo", "path"], "left").selectExpr(
        "repo", "concat('req-', path) AS request_id",
        f"CASE WHEN k = 7 THEN concat('no json for ', path)"
        f" ELSE concat('```json\\n{{\"findings\":[', {item}, ',\"odd\"]}}\\n```') END AS text")


def expected(found: DataFrame) -> DataFrame:
    """Labels for an evaluation: the scan's own findings with every seventh line left out, and one
    invented label for every fifth."""
    lines = ("explode(filter(array(if(line % 7 != 0, line, NULL),"
             " if(line % 5 = 0, line + 100000, NULL)), x -> x IS NOT NULL)) AS line")
    return found.selectExpr("path AS case", "rule_id", lines)


# ----------------------------------------------------------------------------------------- queries

def _file_query(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: big(build(code_files(spark, sf_dir)))


def _raw_query(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: big(build(raw_files(spark, sf_dir)))


def _enriched(spark: SparkSession, sf_dir: str, options: ScanOptions) -> DataFrame:
    return findings.enrich(findings.findings(code_files(spark, sf_dir), options),
                           built_in_catalog(spark))


FINDING_COLUMNS = ("repo", "path", "rule_id", "line", "message", "evidence", "confidence",
                   "signals")


def _hits(rule_id: str, message_like: str | None = None, options: ScanOptions = WINDOW) -> Query:
    def build(files: DataFrame) -> DataFrame:
        found = findings.candidates(files, options).where(F.col("rule_id") == rule_id)
        if message_like:
            found = found.where(F.col("message").startswith(message_like))
        return found.select(*FINDING_COLUMNS)
    return _file_query(build)


CUSTOM = Rule("LOG-002", "line", (P.LOG_CALL, P.MESSAGE_ONLY), (P.SENSITIVE,),
              "Log call prints a bare message.", 0.5, ("bare_message",), skip_comments=True)


def _custom_rule(files: DataFrame) -> DataFrame:
    options = ScanOptions(block_mode="window", custom_rules=(CUSTOM,))
    return findings.candidates(files, options).where("rule_id = 'LOG-002'").select(
        *FINDING_COLUMNS)


MANY = 500


def rule_table(spark: SparkSession) -> DataFrame:
    """Five hundred rules as a table: log calls that hold two letters and a vowel behind them."""
    pair = "concat(char(97 + cast(id div 26 AS int)), char(97 + cast(id % 26 AS int)))"
    return spark.range(MANY).selectExpr(
        "id AS ord", "concat('CUS-', id) AS rule_id", "'line' AS scope",
        "array('python', 'java') AS languages", f"{pair} AS pair").selectExpr(
        "*", f"array(concat(pair, '[aeiou]'), {T.lit(P.LOG_CALL.body)}) AS must",
        "array('escape') AS must_not", "array(pair) AS needs",
        "concat('log call with ', pair) AS message", "0.4D AS confidence",
        "array('letters') AS signals", "true AS skip_comments")


def _custom_rules_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules far longer than the built-in one; built-in hits come out as before."""
    options = ScanOptions(block_mode="window", custom_rules=read_rules(rule_table(spark)))
    found = findings.raw_findings(code_files(spark, sf_dir), options)
    return big(found.select("repo", "path", "rule_id", "line", "message", "confidence"))


def _shouted(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """A user's analyzer: lines and blocks that print."""
    near = lines.where("contains(text, 'print')").selectExpr(
        "repo", "path", "language", "'OWN-1' AS rule_id", "line", "'prints' AS message",
        "text AS evidence", "0.3D AS confidence", "array('own') AS signals")
    around = blocks.where("kind = 'catch' AND contains(text, 'print')").selectExpr(
        "repo", "path", "language", "'OWN-2' AS rule_id", "start_line AS line",
        "'prints where it catches' AS message", "'catch' AS evidence", "0.3D AS confidence",
        "array('own') AS signals")
    return near.unionByName(around)


def _custom_analyzer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = findings.analyzed(code_files(spark, sf_dir), (_shouted,), WINDOW)
    return big(found.select("repo", "path", "rule_id", "line", "message", "fingerprint"))


REDACTION_TABLE = (   # order, expression, mark, a literal of each match
    (1, "th[a-z]+ing", "<THING>", ["th"]), (2, "[0-9]+-[0-9]+", "<RANGE>", None),
    (3, "(password|secret) *[:=] *[^ ,]+", "<GONE>", ["password", "secret"]),
)


def _redact_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a user's own table in place of the built-in ones."""
    own = read_redactions(spark.createDataFrame(
        REDACTION_TABLE, "ord int, body string, mark string, needs array<string>"))
    shapes = secrets(spark, sf_dir).selectExpr("'customer' AS origin", "c_custkey AS id", "0L AS part", "text")
    text = notes_text(spark, sf_dir).unionByName(shapes)
    return text.selectExpr("origin", "id", "part", f"{T.redact('text', own)} AS redacted")


def _language_custom(raw: DataFrame) -> DataFrame:
    options = ScanOptions(suffixes=((".txt", "text"), (".py", "python")),
                          languages_include=("text", "python"))
    return S.language_filter(raw, options).select("repo", "path", "language")


def _corpus_scan(raw: DataFrame) -> DataFrame:
    return S.collect_files(raw, RAW_OPTIONS, RAW_GLOBS).selectExpr(
        "repo", "path", "language", "file_hash", "length(text) AS chars")


def _directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written out as a tree of files by the tasks, then listed and read as a directory."""
    folder = run_folder(spark, "tree")
    root = folder.removeprefix("file://").removeprefix("file:")

    def write(batches):
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                file = Path(root) / path
                file.parent.mkdir(parents=True, exist_ok=True)
                file.write_bytes(text.encode())
            yield batch[["path"]]

    placed = code_files(spark, sf_dir).selectExpr(
        "concat(repo, '/', replace(path, 'svc/', concat('svc/', length(text) % 5, '/'))) AS path", "text")
    landed(placed.mapInPandas(write, "path string"), "written")
    options = ScanOptions(max_file_bytes=1 << 30)
    files = S.collect_files(S.read_directory(spark, root, "tree", options), options)
    return files.selectExpr("repo", "path", "language", "file_hash")


def _file_limit(raw: DataFrame) -> DataFrame:
    options = ScanOptions(max_file_bytes=30_000, max_files=FILE_LIMIT)
    return S.collect_files(raw, options, RAW_GLOBS).select("repo", "path", "language")


def _skip_ledger(raw: DataFrame) -> DataFrame:
    options = ScanOptions(max_file_bytes=30_000, max_files=FILE_LIMIT * 4)
    return S.skip_ledger(raw, options, RAW_GLOBS)


def _clip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = notes_text(spark, sf_dir)
    return big(text.selectExpr("origin", "id", "part", f"{T.clip('text', 300)} AS clipped",
                               f"{T.shorten('text')} AS shortened"))


def _redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    natural = notes_text(spark, sf_dir)
    shapes = secrets(spark, sf_dir).selectExpr("'customer' AS origin", "c_custkey AS id",
                                               "0L AS part", "text")
    return natural.unionByName(shapes).selectExpr("origin", "id", "part",
                                                  f"{T.redact('text')} AS redacted")


def _summary(spark: SparkSession, sf_dir: str, options: ScanOptions = WINDOW) -> DataFrame:
    return metrics.scan_summary(code_files(spark, sf_dir), None, options)


def _scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(_summary(spark, sf_dir))


def _severity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _enriched(spark, sf_dir, WINDOW)
    return big(found.selectExpr("path", "line", "rule_id", "fingerprint",
                                f"{T.severity_rank('severity')} AS severity_rank",
                                f"{T.sarif_level('severity')} AS sarif_level"))


def _checked(files: DataFrame) -> DataFrame:
    """Findings of one scan, written: they are judged, and the labels are derived from them."""
    found = findings.checked_findings(files, WINDOW).select("path", "rule_id", "line", "evidence_valid")
    return landed(found.withColumn("case", F.col("path")), "checked")


def _evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    found = _checked(files)
    return big(metrics.evaluate(found, expected(found), files))


def _evaluate_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _checked(code_files(spark, sf_dir))
    pairs = metrics.confusion(found, expected(found))
    return big(metrics.ratios(metrics.totals(pairs, "rule_id"), "rule_id"))


def _evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    found = landed(findings.raw_findings(files, WINDOW), "findings")
    # Every fifth line gets evidence whose last line is not in its file.
    found = found.withColumn("evidence", F.expr(
        "if(line % 5 = 0, concat(evidence, '\n', 'nowhere in ', path), evidence)"))
    return big(metrics.with_evidence_check(found, files).select("path", "rule_id", "line",
                                                                "message", "evidence_valid"))


def _first_snippets(files: DataFrame) -> DataFrame:
    return snippets.first_snippets(snippets.snippets(files, WINDOW), 40).select(
        "path", "start_line", "end_line", "text", "reason")


def _snippet_windows(files: DataFrame) -> DataFrame:
    return snippets.snippets(files, WINDOW).select("path", "start_line", "end_line", "text",
                                                   "reason")


def _snippets_per_file(files: DataFrame) -> DataFrame:
    return snippets.candidate_snippets(files, WINDOW).select(
        "path", "start_line", "end_line", "reason", "symbol", "snippet_id", "candidate_rule_ids",
        "signals", "text")


def _snippet_ids(files: DataFrame) -> DataFrame:
    return snippets.redact_snippets(snippets.snippets(files, WINDOW), WINDOW).select(
        "path", "start_line", "end_line", "snippet_id", "text")


def _prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return external.prompt_batches(code_files(spark, sf_dir), built_in_catalog(spark), SCOPED)


def _prompt_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(external.prompt_bins(code_files(spark, sf_dir), built_in_catalog(spark), WINDOW))


def _reviewer(batches):
    """Answers by the id of the request: some only when asked again, some never."""
    for batch in batches:
        wanting = batch["request_id"].str[0].isin(list("0123")) & (batch["attempt"] == 1)
        never = batch["request_id"].str[0] == "f"
        texts = ("{\"findings\":[], \"of\":\"" + batch["request_id"].str[:8] + "\"}").where(
            ~(wanting | never), "no answer to " + batch["request_id"].str[:8])
        yield batch[["request_id"]].assign(text=texts)


def _review_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over the corpus: some answered by an earlier run, the others asked, asked again, merged.
    The second run over the same folder finds nothing to ask and changes nothing."""
    bins = external.prompt_bins(code_files(spark, sf_dir), built_in_catalog(spark), WINDOW)
    requests = bucketed(bins, ("request_id",), "requests")
    earlier = requests.where("request_id LIKE 'a%' OR request_id LIKE 'b%'").selectExpr(
        "request_id", "if(request_id LIKE 'b%', 'broken', '{\"findings\":[]}') AS text")
    folder = run_folder(spark, "exchange")
    for _ in range(2):
        found = exchange.exchange(requests, _reviewer, folder, known=earlier)
    return big(found.select("repo", "batch", "request_id", "state", "attempts", "text"))


def _cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = code_files(spark, sf_dir).selectExpr(
        "repo", "path", "concat('req-', path) AS request_id")
    known = responses(spark, sf_dir).where("NOT startswith(text, 'no json')").where(
        "endswith(request_id, '.py')")
    return external.cache_misses(requests, known).select("request_id", "path")


def _response_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(external.parse_responses(responses(spark, sf_dir)))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals = landed(external.parse_responses(responses(spark, sf_dir)), "proposals")
    return external.judge(proposals, code_files(spark, sf_dir), built_in_catalog(spark), WINDOW)


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of the files as they are, of the corpus derived from them, and of its review."""
    files = code_files(spark, sf_dir)
    coded = files.selectExpr("repo", "path", "encode(text, 'UTF-8') AS content").selectExpr(
        "repo", "path", "cast(length(content) AS bigint) AS length", "content")
    proposals = landed(external.parse_responses(responses(spark, sf_dir)), "proposals")
    judged = external.judge(proposals, files, built_in_catalog(spark), WINDOW)
    return (notes.scan_notes(raw_files(spark, sf_dir), RAW_OPTIONS, RAW_GLOBS)
            .unionByName(notes.scan_notes(coded, ScanOptions(max_file_bytes=1 << 30)))
            .unionByName(notes.review_notes(proposals, judged.where("reason != 'accepted'"))))


def _validate_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(external.accepted(_judged(spark, sf_dir)).selectExpr(
        "repo", "path", "language", "rule_id", "line", "message", "evidence", "confidence"))


def _rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(external.rejections(_judged(spark, sf_dir)))


def _merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    result = scan_files(files, files.limit(0), built_in_catalog(spark), WINDOW)
    merged, _ = with_external(result, responses(spark, sf_dir))
    return big(merged.select("repo", "path", "rule_id", "line", "analyzer", "severity",
                             "fingerprint"))


def _gate_after_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    result = scan_files(files, files.limit(0), built_in_catalog(spark), replace(WINDOW, fail_on_severity="medium"))
    return big(reviewed(result, responses(spark, sf_dir)).gate())


def _suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_files(spark, sf_dir)
    return big(findings.suppress(findings.raw_findings(files, WINDOW),
                                 findings.suppressions(files, WINDOW)).select(*FINDING_COLUMNS))


def _fingerprint(files: DataFrame) -> DataFrame:
    return findings.with_fingerprint(findings.raw_findings(files, WINDOW)).select(
        "path", "rule_id", "line", "message", "fingerprint")


def _fingerprint_dedupe(files: DataFrame) -> DataFrame:
    return findings.fingerprint_dedupe(findings.raw_findings(files, WINDOW)).select(
        "path", "rule_id", "line", "message", "fingerprint")


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(findings.ordered(_enriched(spark, sf_dir, WINDOW)).select(
        "repo", "path", "line", "rule_id", "severity", "message", "fingerprint"))


def _findings(options: ScanOptions) -> Query:
    return lambda spark, sf_dir: big(_enriched(spark, sf_dir, options).select(
        "repo", "path", "line", "rule_id", "rule_title", "severity", "category", "message",
        "evidence", "confidence", "fingerprint"))


def _rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rule of the catalog with the findings the corpus holds for it."""
    counts = metrics.by_rule(findings.findings(code_files(spark, sf_dir), WINDOW))
    catalog = built_in_catalog(spark).selectExpr(
        "id AS rule_id", "title", "severity", "category", "analysis_mode",
        "array_join(languages, ',') AS languages", "array_join(standards, ',') AS standards",
        "size(source_refs) AS sources", "size(deterministic_signals) AS signals")
    return big(catalog.join(counts, "rule_id", "left").na.fill(0, ["findings"]))


def _source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(_enriched(spark, sf_dir, WINDOW).selectExpr(
        "path", "line", "rule_id", "fingerprint", f"{T.source_links('source_refs')} AS links"))


def _report(kind: str) -> Query:
    at = "timestamp'2024-01-01 00:00:00'"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = built_in_catalog(spark)
        once = landed(metrics.scanned(code_files(spark, sf_dir), SCOPED), "scanned")
        found = landed(findings.enrich(findings.found_in(once, SCOPED), catalog), "findings")
        total = landed(metrics.summary_of(once), "summary")
        if kind == "json":
            out = exports.export_json(found, total, catalog, SCOPED, generated_at=at,
                                      languages=metrics.files_by_language(once))
        elif kind == "sarif":
            out = exports.export_sarif(found, total, catalog)
        elif kind == "markdown":
            out = exports.export_markdown(found, total, catalog, generated_at=at)
        else:
            out = exports.export_html(found, total)
        return big(out)
    return query


def _export_html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big(_enriched(spark, sf_dir, WINDOW).selectExpr(
        "path", "line", "rule_id", "fingerprint", f"{exports.finding_html()} AS html"))


def _scan_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream of files, scanned until all that is there has been read."""
    schema = table(spark, sf_dir, "documents").schema
    # A pattern, so that a single file and a directory of files both serve as the source.
    docs = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    raw = as_code(docs).selectExpr(
        "repo", "path", "encode(text, 'UTF-8') AS content").selectExpr(
        "repo", "path", "cast(length(content) AS bigint) AS length", "content")
    found = stream.stream_findings(raw, ScanOptions(max_file_bytes=1 << 30))
    run = run_folder(spark, "scan-stream")
    query = stream.run_available(found, f"{run}/out", f"{run}/state")
    query.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{run}/out")
    return big(rows.select("repo", "path", "rule_id", "line", "message", "evidence", "confidence",
                           "fingerprint"))


DELIVERY_FILES = 6
DELIVERY_ROW_GROUP = 8 << 20


def _delivered_twice(docs: DataFrame, key: str, run: str, start: Callable) -> None:
    """All documents arrive in several files, a stream reads them in batches and stops; then all arrive
    again, and the stream is started anew on the state it left behind."""
    spark, arrived = docs.sparkSession, f"{run}/arrived"
    for _ in range(2):
        # Small row groups: each large file of a batch is read by many tasks.
        docs.repartition(DELIVERY_FILES, key).write.mode("append").option(
            "parquet.block.size", DELIVERY_ROW_GROUP).parquet(arrived)
        stream_ = (spark.readStream.schema(docs.schema)
                   .option("maxFilesPerTrigger", DELIVERY_FILES // 2).parquet(arrived))
        start(stream_).awaitTermination()


def _raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as raw files. It is derived before it is delivered: a stream that derived it would do so
    again in each test of a file."""
    docs = table(spark, sf_dir, "documents")
    coded = as_code(docs).selectExpr("repo", "path", "encode(text, 'UTF-8') AS content")
    return coded.selectExpr("repo", "path", "cast(length(content) AS bigint) AS length", "content")


def _streamed_findings(raw: DataFrame) -> DataFrame:
    return stream.stream_findings(raw, ScanOptions(max_file_bytes=1 << 30))


def _stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents that arrive twice: each fingerprint comes out once, across batches and a
    restart."""
    run = run_folder(spark, "stream-unseen")
    _delivered_twice(_raw_corpus(spark, sf_dir), "path", run, lambda raw: stream.run_available(
        stream.first_seen(_streamed_findings(raw)), f"{run}/out", f"{run}/state"))
    rows = spark.read.parquet(f"{run}/out")
    return big(rows.select("repo", "path", "rule_id", "line", "message", "evidence", "confidence",
                           "fingerprint"))


def _stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of findings by repo and rule, kept across batches and a restart."""
    run = run_folder(spark, "stream-counts")
    keys = ("repo", "rule_id")
    _delivered_twice(_raw_corpus(spark, sf_dir), "path", run, lambda raw: stream.run_counts(
        _streamed_findings(raw), keys, f"{run}/out", f"{run}/state"))
    return big(stream.latest_counts(spark, f"{run}/out", keys))


def _unscanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that no earlier scan has met. The labelled documents were scanned before; all documents
    arrive twice, some of them copies of others."""
    docs = table(spark, sf_dir, "documents")
    hashes = "sha2(encode(text, 'UTF-8'), 256) AS file_hash"
    before = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id",
                       "left_semi").selectExpr(hashes)
    run = run_folder(spark, "unscanned")
    seen = landed(before, "hashes")

    def start(arrived: DataFrame):
        files = arrived.selectExpr("text", hashes)
        return stream.run_available(
            stream.new_files(files, seen).selectExpr("file_hash", "length(text) AS chars"),
            f"{run}/out", f"{run}/state")
    _delivered_twice(docs, "doc_id", run, start)
    return big(spark.read.parquet(f"{run}/out"))


def queries() -> dict[str, Query]:
    return {
        # sources
        "corpus_scan": _raw_query(_corpus_scan),
        "directory_scan": _directory_scan,
        "language_filter": _raw_query(lambda raw: S.language_filter(
            raw, ScanOptions(languages_exclude=("java",))).select("repo", "path", "language")),
        "language_custom": _raw_query(_language_custom),
        "ignore_filter": _raw_query(lambda raw: S.ignore_filter(raw, RAW_GLOBS).select(
            "repo", "path")),
        "file_quality": _raw_query(lambda raw: S.file_quality(raw, RAW_OPTIONS).select(
            "repo", "path", "length", "skip_reason")),
        "content_hash": lambda spark, sf_dir: table(spark, sf_dir, "documents").selectExpr(
            "doc_id", "sha2(encode(text, 'UTF-8'), 256) AS file_hash"),
        "skip_ledger": _raw_query(_skip_ledger),
        "file_limit": _raw_query(_file_limit),
        "rule_catalog": _rule_catalog,
        # extractors
        "line_explode": _file_query(extract.lines),
        "predicate_flags": _file_query(extract.predicate_flags),
        "symbols": _file_query(extract.symbols),
        "imports": _file_query(extract.imports),
        "logger_calls": _file_query(extract.logger_calls),
        "console_calls": _file_query(extract.console_calls),
        "symbol_for_line": _file_query(lambda files: extract.calls(
            files, P.TECHNICAL_RESPONSE, "response")),
        "exception_blocks": _file_query(lambda f: extract.exception_blocks(f, "window")),
        "exception_blocks_scoped": _file_query(
            lambda f: extract.exception_blocks(f, "scoped").drop("symbol")),
        "api_handlers": _file_query(extract.api_handlers),
        "global_handlers": _file_query(extract.global_handlers),
        # rules
        "rule_log003": _hits("LOG-003"),
        "rule_log004": _hits("LOG-004"),
        "rule_log007": _hits("LOG-007"),
        "rule_err002_line": _hits("ERR-002", "Technical exception details"),
        "rule_log005_line": _file_query(lambda f: findings.candidates(f, WINDOW).where(
            "rule_id = 'LOG-005' AND signals[0] = 'console_logging'").select(*FINDING_COLUMNS)),
        "rule_err003": _hits("ERR-003"),
        "rule_log005_block": _file_query(lambda f: findings.candidates(f, WINDOW).where(
            "rule_id = 'LOG-005' AND signals[0] = 'catch_block'").select(*FINDING_COLUMNS)),
        "rule_err002_block": _hits("ERR-002", "Exception handler"),
        "rule_err001": _hits("ERR-001"),
        "all_candidates": _file_query(lambda f: findings.candidates(f, WINDOW).select(
            *FINDING_COLUMNS, "analyzer_ord")),
        "custom_rule": _file_query(_custom_rule),
        "custom_rules_many": _custom_rules_many,
        "custom_analyzer": _custom_analyzer,
        # findings
        "dedupe_candidates": _file_query(lambda f: findings.dedupe_candidates(
            findings.candidates(f, WINDOW)).select(*FINDING_COLUMNS, "analyzer_ord")),
        "raw_findings": _file_query(lambda f: findings.raw_findings(f, WINDOW).select(
            *FINDING_COLUMNS, "analyzer_ord")),
        "suppressions": _file_query(lambda f: findings.suppressions(f, WINDOW)),
        "suppress": _suppress,
        "fingerprint": _file_query(_fingerprint),
        "fingerprint_dedupe": _file_query(_fingerprint_dedupe),
        "findings_enriched": _findings(WINDOW),
        "findings_scoped": _findings(SCOPED),
        "severity_rank": _severity_rank,
        "ordered_findings": _ordered,
        # text
        "redact_text": _redact_text,
        "redact_custom": _redact_custom,
        "clip_text": _clip_text,
        # snippets
        "hotspots": _file_query(lambda f: snippets.hotspots(f, WINDOW).drop("repo", "language")),
        "hotspots_scoped": _file_query(
            lambda f: snippets.hotspots(f, SCOPED).drop("repo", "language")),
        "snippet_windows": _file_query(_snippet_windows),
        "first_snippets": _file_query(_first_snippets),
        "snippets_per_file": _file_query(_snippets_per_file),
        "snippet_ids": _file_query(_snippet_ids),
        # external review
        "prompt_batches": _prompt_batches,
        "prompt_bins": _prompt_bins,
        "review_exchange": _review_exchange,
        "cache_misses": _cache_misses,
        "response_parse": _response_parse,
        "validate_external": _validate_external,
        "rejections": _rejections,
        "notes": _notes,
        "merge_findings": _merge_findings,
        "gate_after_review": _gate_after_review,
        # metrics
        "by_severity": lambda s, d: big(metrics.by_severity(_enriched(s, d, WINDOW))),
        "by_severity_filled": lambda s, d: big(metrics.by_severity_filled(
            _enriched(s, d, WINDOW), code_files(s, d))),
        "by_rule": _file_query(lambda f: metrics.by_rule(findings.findings(f, WINDOW))),
        "by_language": _file_query(metrics.by_language),
        "total_loc": lambda s, d: big(metrics.total_loc(notes_text(s, d))),
        "scan_summary": _scan_summary,
        "severity_gate": lambda s, d: big(metrics.severity_gate(
            _enriched(s, d, WINDOW), code_files(s, d), "high")),
        "evaluate": _evaluate,
        "evaluate_by_rule": _evaluate_by_rule,
        "evidence_check": _evidence_check,
        # reports
        "source_links": _source_links,
        "export_json": _report("json"),
        "export_sarif": _report("sarif"),
        "export_markdown": _report("markdown"),
        "export_html": _report("html"),
        "export_html_sections": _export_html_sections,
        "scan_stream": _scan_stream,
        "stream_unseen": _stream_unseen,
        "stream_counts": _stream_counts,
        "unscanned": _unscanned,
    }
