"""Exchange with an external reviewer: requests out, responses in, findings validated.

The reviewer itself is outside. Requests are a table keyed by a content hash; a response table keyed
the same way is both the input and the cache, so a job sends only what has no answer yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions import text as T
from siftspark.functions.sql import (
    each, each_at, first_of, fresh, keep, let, lit, struct, when,
)
from siftspark.operators import extract as X
from siftspark.operators.findings import deduped_array, mark_array
from siftspark.operators.rules import emissions
from siftspark.operators.snippets import snippet_array
from siftspark.options import ScanOptions
from siftspark.sources.landing import bucketed, landed

ANALYZER = "semantic"
EXTERNAL_ORD = 1000        # after every analyzer of the scan itself
# Fixed value: the JSON shape an answer has to keep to.
SHAPE = (
    '{"findings":[{"rule_id":"LOG-001","path":"file.py","line":12,"message":"short problem",'
    '"evidence":"short evidence from snippet","recommendation":"specific fix",'
    '"confidence":0.0}]}'
)
INSTRUCTIONS = (
    "Below are rules on logging and on the handling of exceptions, and excerpts of source files. "
    "Name each place where an excerpt breaks one of these rules. A finding needs a rule from the "
    "list, a path and a line of the excerpts, and a quotation that proves it; leave out whatever "
    f"you cannot prove.\n\nAnswer with one JSON object like this and nothing else:\n{SHAPE}"
)
DEFAULT_MESSAGE = "Semantic rule matched."


# ---------------------------------------------------------------------------------------- requests

def review_rules(catalog: DataFrame) -> DataFrame:
    """One row: the rules a reviewer is asked about, as JSON, and all rule ids in id order."""
    rule = F.struct("id", "title", "severity", "description",
                    F.col("semantic_prompt").alias("semantic_check"), "recommendation",
                    "standards")
    asked = F.when(F.col("analysis_mode").isin("semantic", "hybrid"), rule)
    return catalog.agg(
        F.to_json(F.sort_array(F.collect_list(asked))).alias("rules_json"),
        F.sort_array(F.collect_list("id")).alias("rule_ids"))


def _payload(s: str, options: ScanOptions) -> str:
    """What a request says of one snippet."""
    body = f"{s}.text"
    if options.redact:
        body = let(body, lambda t: T.redact(t, options.redactions))
    return struct(
        snippet_id=T.snippet_id("path", f"{s}.start_line", f"{s}.end_line", f"{s}.text"),
        path="path", language="language", start_line=f"{s}.start_line",
        end_line=f"{s}.end_line", symbol="cast(NULL AS string)",
        candidate_rule_ids="cast(array() AS array<string>)",
        deterministic_signals="cast(array() AS array<string>)",
        reason=f"{s}.reason", text=body)


def _requests(parts: DataFrame, catalog: DataFrame, options: ScanOptions, *columns: str) -> DataFrame:
    """``parts`` with a payload as requests: the id says what is asked, of which rules, of whom."""
    # The rules are one small row: read once as values instead of joined to every request.
    rules = review_rules(catalog)
    key = F.concat_ws("\n", F.lit(options.catalog_version), F.lit(options.model),
                      rules.select(F.array_join("rule_ids", ",")).scalar(), F.col("payload"))
    prompt = F.concat(F.lit(INSTRUCTIONS + "\n\nRules:\n"), rules.select("rules_json").scalar(),
                      F.lit("\n\nSnippets:\n"), F.col("payload"))
    return parts.select(*columns, F.sha2(key, 256).alias("request_id"), "batch", "snippets", prompt.alias("prompt"))


def prompt_batches(files: DataFrame, catalog: DataFrame,
                   options: ScanOptions = ScanOptions()) -> DataFrame:
    """Requests of at most ``max_snippets`` snippets of one file: (repo, path, request_id, ...).

    Batches are cut inside the file's row: nothing is collected across files.
    """
    n = options.max_snippets

    def batches(found: str) -> str:
        return each_at(
            f"transform(sequence(0, greatest(0, ceil(size({found}) / {n}) - 1)),"
            f" b -> slice({found}, cast(b * {n} + 1 AS int), {n}))",
            lambda part, i: struct(
                line=f"{i} + 1", snippets=f"size({part})",
                payload=f"to_json({part}, map('ignoreNullFields', 'false'))"))

    cut = files.select(*X.KEYS, F.expr(snippet_array(options)).alias("cut"))
    found = let(each("cut", lambda s: _payload(s, options)), lambda a: when(f"size({a}) > 0", batches(a)))
    parts = X.rows(cut, found).withColumnRenamed("line", "batch")
    return _requests(parts, catalog, options, "repo", "path")


def _begun(runs: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``runs`` (order columns, n) with ``begin``: the sum of n over all earlier runs of the same repo.

    Runs are sorted by ranges of ``order``, so a repo of any size spreads over many tasks. Sums are taken
    inside each part; then the parts of a repo, a row each, are summed.
    """
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = landed(runs.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "runs")
    inside = Window.partitionBy("repo", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("repo").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("repo", "part").agg(F.sum("n").alias("total")).select(
        "repo", "part", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("ahead"))
    summed = parts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return summed.join(totals, ["repo", "part"]).selectExpr(*order, "ahead + before AS begin")


def prompt_bins(files: DataFrame, catalog: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Requests over several files: (repo, request_id, batch, snippets, prompt).

    The snippets of a repo in rank order, windows around findings before hotspots and files by path, are cut
    into bins of ``max_snippets``; bin 1 is what a run with a limit would send. Only counts are ranked; a
    request gathers the snippets of one bin.
    """
    found = each(snippet_array(options), lambda s: struct(
        line="1", phase=f"{s}.phase", seq=f"{s}.seq", payload=f"to_json({_payload(s, options)}, map('ignoreNullFields', 'false'))"))
    file = ("repo", "path")
    rows = bucketed(X.rows(files, found).select(*file, "phase", "seq", "payload"), file, "snippets")
    order = ("repo", "phase", "path")
    begun = _begun(rows.groupBy(*order).agg(F.count("*").alias("n")), order)
    # A row per file and its key alone in the join, so that the counts move and the texts do not.
    begins = begun.groupBy(*file).agg(F.map_from_entries(F.collect_list(F.struct("phase", "begin"))).alias("begins"))
    in_run = Window.partitionBy(*file, "phase").orderBy("seq")      # as many rows as a file has snippets
    ranked = rows.withColumn("at", F.row_number().over(in_run) - 1).join(begins, list(file)).selectExpr(
        "repo", "begins[phase] + at AS rank", "payload").selectExpr(
        "repo", "rank", f"rank div {options.max_snippets} AS bin", "payload")
    bins = ranked.groupBy("repo", "bin").agg(
        F.sort_array(F.collect_list(F.struct("rank", "payload"))).alias("held")).selectExpr(
        "repo", "bin + 1 AS batch", "size(held) AS snippets",
        "concat('[', array_join(transform(held, h -> h.payload), ','), ']') AS payload")
    return _requests(bins, catalog, options, "repo")


def cache_misses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests without an answer."""
    return requests.join(responses.select("request_id").distinct(), "request_id", "left_anti")


def ask(requests: DataFrame, reviewer: Callable[[Iterator], Iterator]) -> DataFrame:
    """Run a user's ``mapInPandas`` reviewer over the open requests: (repo, request_id, text)."""
    return requests.select("repo", "path", "request_id", "prompt").mapInPandas(
        reviewer, "repo string, request_id string, text string")


def invalid_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests whose answer was not JSON: to be asked once more."""
    bad = parse_responses(responses).where("NOT valid_json").select("request_id").distinct()
    return requests.join(bad, "request_id", "left_semi")


# --------------------------------------------------------------------------------------- responses

def _json_text(text: str) -> str:
    """The object inside a response: code fence removed, cut from the first to the last brace."""
    def unfence(t: str) -> str:
        opened = T.strip(f"regexp_replace({t}, {lit('^```(?:json)?')}, '')")
        return when(f"startswith({t}, '```')",
                    T.strip(f"regexp_replace({opened}, {lit('```$')}, '')"), t)

    def cut(t: str) -> str:
        return f"coalesce(nullif(regexp_extract({t}, {lit('(?s)[{].*[}]')}, 0), ''), {t})"
    return let(let(T.strip(text), unfence), cut)


def parse_responses(responses: DataFrame) -> DataFrame:
    """One row per finding proposed, plus one noted row per invalid response or odd item.

    Items stay variants until their fields are read, so an item that is no object is seen as such.
    """
    items = when("parsed IS NOT NULL", "try_variant_get(parsed, '$.findings', 'array<variant>')")

    def text_of(item: str, field: str) -> str:
        return T.strip(f"try_variant_get({item}, '$.{field}', 'string')")

    def row(item: str, i: str) -> str:
        is_object = f"startswith(schema_of_variant({item}), 'OBJECT')"
        line = f"try_variant_get({item}, '$.line', 'string')"
        whole = (f"coalesce(try_cast({line} AS int), "
                 + when(f"NOT startswith(schema_of_variant(try_variant_get({item}, '$.line',"
                        f" 'variant')), 'STRING')",
                        f"cast(try_cast({line} AS double) AS int)") + ", 0)")
        value = struct(
            rule_id=f"coalesce({text_of(item, 'rule_id')}, '')",
            path=f"coalesce({text_of(item, 'path')}, '')",
            line=whole,
            message=f"coalesce(nullif({text_of(item, 'message')}, ''), {lit(DEFAULT_MESSAGE)})",
            evidence=f"coalesce({text_of(item, 'evidence')}, '')",
            recommendation=f"coalesce({text_of(item, 'recommendation')}, '')",
            confidence=f"coalesce(try_cast(try_variant_get({item}, '$.confidence', 'string')"
                       f" AS double), 0D)",
            language=f"coalesce({text_of(item, 'language')}, '')")
        return struct(
            item_ord=f"{i} + 1",
            note=when(is_object, "cast(NULL AS string)",
                      "'Semantic finding skipped because it was not an object.'"),
            value=when(is_object, value))

    parsed = responses.selectExpr(
        "repo", "request_id", f"try_parse_json({_json_text('text')}) AS parsed").selectExpr(
        "repo", "request_id",
        "CASE WHEN startswith(schema_of_variant(parsed), 'OBJECT') THEN parsed END AS parsed")
    exploded = parsed.selectExpr(
        "repo", "request_id", "parsed IS NOT NULL AS valid_json",
        f"explode_outer({each_at(f'({items})', row)}) AS item")
    return exploded.where("NOT valid_json OR item IS NOT NULL").selectExpr(
        "repo", "request_id", "valid_json", "item.item_ord AS item_ord",
        "CASE WHEN NOT valid_json THEN 'Semantic analysis response was not valid JSON.'"
        " ELSE item.note END AS note",
        *[f"item.value.{f} AS {f}" for f in (
            "rule_id", "path", "line", "message", "evidence", "recommendation", "confidence",
            "language")])


# -------------------------------------------------------------------------------------- validation

BLOOM_BITS = 1 << 22      # half a megabyte, whatever the number of keys
BLOOM_SEEDS = (11, 23, 47)


def _bloom_places(keys: tuple[str, ...]) -> str:
    hashes = ", ".join(f"pmod(xxhash64({seed}, {', '.join(keys)}), {BLOOM_BITS})" for seed in BLOOM_SEEDS)
    return f"array({hashes})"


def bloom_filter(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row with ``words``: a Bloom filter of the keys as a dense array of 64-bit words.

    Bits are joined by word in the tasks, so at most ``BLOOM_BITS / 64`` short rows meet, for any input.
    """
    spark = rows.sparkSession
    places = rows.select(F.explode(F.expr(_bloom_places(keys))).alias("place"))
    words = places.selectExpr("place div 64 AS word", "shiftleft(1L, cast(place % 64 AS int)) AS bit").groupBy(
        "word").agg(F.expr("bit_or(bit)").alias("bits"))
    dense = spark.range(BLOOM_BITS // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    pairs = F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return dense.agg(F.transform(pairs, lambda p: p["bits"]).alias("words"))


def is_named(named: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> Column:
    """Whether a row of ``named`` may have the key. Few others pass, none of these is lost; nothing moves but the
    filter, which is a value of fixed size in the plan."""
    held = landed(bloom_filter(named, keys), "bloom").scalar()
    tests = F.lit(True)
    for seed in BLOOM_SEEDS:
        place = F.expr(f"pmod(xxhash64({seed}, {', '.join(keys)}), {BLOOM_BITS})")
        bit = F.get(held, (place / 64).cast("int"))
        tests &= F.getbit(bit, (place % 64).cast("int")) == 1
    return tests


def named_files(files: DataFrame, named: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Files whose key a row of ``named`` may have."""
    return files.where(is_named(named, keys))


def review_facts(files: DataFrame, options: ScanOptions, named: Column | None = None) -> DataFrame:
    """What a proposal is tested against, and what the scan itself finds, one row per file.

    ``hits`` and ``marks`` (``findings.raw_of``, ``findings.marks_of``) are of every file; only ``named`` ones
    keep their text and their snippets.
    """
    named = F.lit(True) if named is None else named
    matched = files.select("repo", "path", "language", "text", F.expr(deduped_array(options)).alias("hits"),
                           F.expr(mark_array(options)).alias("marks"), named.alias("named"))
    shown = each(snippet_array(options, bodies=False, hits="hits"), lambda s: struct(
        start_line=f"{s}.start_line", end_line=f"{s}.end_line", text=f"{s}.text"))
    return matched.selectExpr(
        "repo", "path", "language", when("named", "text") + " AS file_text",
        when("named", f"size({T.split_lines('text')})") + " AS file_lines", when("named", shown) + " AS shown",
        "hits", "marks", "named")


def answered(questions: DataFrame, facts: DataFrame, options: ScanOptions) -> DataFrame:
    """(repo, path, line, evidence) with what the file says to it, without its text.

    ``facts`` is bucketed by file: the questions move, texts stay where they were written.
    """
    rule_ids = "array(" + ", ".join(lit(e.rule.rule_id) for e in emissions(options.custom_rules)) + ")"
    facts = facts.where("named").select("repo", "path", "file_text", "file_lines", "shown", "hits", F.col("language").alias(
        "file_language"))
    s, o = fresh("s"), fresh("o")
    first = first_of(f"filter(shown, {s} -> {s}.start_line <= line AND line <= {s}.end_line)")
    joined = questions.join(facts, ["repo", "path"]).withColumn("snippet", F.expr(first))
    # Windows overlap, so their texts would be many times the file; the one that is needed is cut
    # from the file here, and only looked at if the evidence is not found in the file as it is.
    body = T.clip("coalesce(snippet.text, array_join(slice(" + T.split_lines("file_text")
                  + ", snippet.start_line, snippet.end_line - snippet.start_line + 1), '\n'))",
                  options.clip_chars)
    shown_text = T.redact(body, options.redactions) if options.redact else body
    return joined.selectExpr(
        "repo", "path", "line", "evidence", "file_language", "file_lines",
        "snippet IS NOT NULL AS in_snippet", "snippet.start_line AS snippet_start", "snippet.end_line AS snippet_end",
        f"transform(filter(hits, {o} -> {o}.line = line), {o} -> element_at({rule_ids}, {o}.hit + 1)) AS own_rules",
        f"evidence = '' OR contains(file_text, evidence) OR contains({shown_text}, evidence) AS quoted")


# Reasons in the order they are tested; the first that applies counts.
def _verdict(options: ScanOptions) -> str:
    return (
        "CASE WHEN severity IS NULL THEN 'unknown_rule'"
        " WHEN file_lines IS NULL THEN 'path_not_scanned'"
        " WHEN NOT in_snippet THEN 'no_snippet'"
        " WHEN line < 1 OR line > file_lines THEN 'line_outside_file'"
        " WHEN line < snippet_start OR line > snippet_end THEN 'line_outside_snippet'"
        " WHEN severity IN ('critical', 'high', 'medium') AND evidence = '' THEN 'no_evidence'"
        " WHEN NOT quoted THEN 'evidence_not_found'"
        f" WHEN least(greatest(confidence, 0D), 1D) < {options.min_confidence}D"
        "  THEN 'low_confidence'"
        " WHEN array_contains(own_rules, rule_id) THEN 'duplicate'"
        " ELSE 'accepted' END"
    )


NOTES = {  # fixed values
    "unknown_rule": "concat('unknown rule_id ', rule_id)",
    "path_not_scanned": "concat('path was not scanned: ', path)",
    "no_snippet": "concat('path was not included in snippets: ', path)",
    "line_outside_file": "concat('line outside file range: ', path, ':', line)",
    "line_outside_snippet": "concat('line outside snippet range: ', path, ':', line)",
    "no_evidence": "concat('missing evidence for ', rule_id)",
    "evidence_not_found": "concat('evidence not found in source: ', path)",
    "low_confidence": "concat('confidence below threshold for ', rule_id)",
    "duplicate": "concat('duplicates deterministic finding: ', path, ':', line)",
}


QUESTION = ("repo", "path", "line", "evidence")


def facts_of(proposals: DataFrame, files: DataFrame, options: ScanOptions) -> DataFrame:
    """``review_facts`` of all files, from one pass over them: for the scan's own findings and for ``judge``."""
    questions = proposals.where("note IS NULL").select(*QUESTION).distinct()
    return bucketed(review_facts(files, options, is_named(questions)), ("repo", "path"), "facts")


def judge(proposals: DataFrame, files: DataFrame, catalog: DataFrame,
          options: ScanOptions = ScanOptions(), facts: DataFrame | None = None) -> DataFrame:
    """Every proposal with its verdict and note.

    Files that no proposal names are left out by a Bloom filter before anything moves. The others are
    prepared and written bucketed by file, each task its own ones, so no exchange holds a text; ``facts_of``
    gives ``facts`` that are written already. Proposals that ask the same (file, line, evidence) are one
    question; the answers, a few numbers each, go back to the proposals through a join that Spark can split
    where a file is named very often.
    """
    asked = proposals.where("note IS NULL")
    question = QUESTION
    questions = asked.select(*question).distinct()
    if facts is None:
        facts = bucketed(review_facts(named_files(files, questions), options), ("repo", "path"), "facts")
    answers = landed(answered(questions, facts, options), "answers")
    rules = catalog.selectExpr("id AS rule_id", "severity", "title AS rule_title", "category",
                               "recommendation AS rule_recommendation", "source_refs")
    joined = asked.join(answers, list(question), "left").join(rules, "rule_id", "left")
    judged = joined.withColumn("reason", F.expr(_verdict(options)))
    cases = " ".join(f"WHEN {lit(k)} THEN concat('Semantic finding rejected: ', {v})"
                     for k, v in NOTES.items())
    return judged.withColumn("verdict_note", F.expr(f"CASE reason {cases} END")).drop(
        "in_snippet", "snippet_start", "snippet_end", "own_rules", "quoted", "file_lines", "note")


def accepted(judged: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Accepted proposals as findings: catalog fields, masked evidence, bounded confidence."""
    return judged.where("reason = 'accepted'").selectExpr(
        "repo", "path", "file_language AS language", "rule_id", "line", "message",
        f"{T.redact('evidence', options.redactions)} AS evidence", f"{lit(ANALYZER)} AS analyzer",
        "least(greatest(confidence, 0D), 1D) AS confidence",
        "cast(array() AS array<string>) AS signals", f"{EXTERNAL_ORD} AS analyzer_ord",
        "cast(item_ord AS bigint) AS seq",
        "request_id", "coalesce(nullif(recommendation, ''), rule_recommendation) AS own_recommendation")


def rejections(judged: DataFrame) -> DataFrame:
    """(repo, request_id, item_ord, reason, note) of the proposals that were turned down."""
    return judged.where("reason != 'accepted'").selectExpr(
        "repo", "request_id", "item_ord", "reason", "verdict_note AS note")
