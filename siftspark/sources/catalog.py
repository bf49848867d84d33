"""Rule catalog source: a JSON document, or the built-in rules, as a small dimension table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.sql import lit
from siftspark.sources.catalog_values import RULES

RULE_SCHEMA = (
    "id string, title string, category string, severity string, analysis_mode string, "
    "languages array<string>, description string, recommendation string, "
    "standards array<string>, source_refs array<struct<title:string,url:string,"
    "line_start:int,line_end:int,note:string>>, semantic_prompt string, "
    "deterministic_signals array<string>"
)
_LISTS = ("languages", "standards", "source_refs", "deterministic_signals")


def _with_defaults(rules: DataFrame) -> DataFrame:
    """Lists a document leaves out are empty, not null."""
    for name in _LISTS:
        kind = rules.schema[name].dataType.simpleString()
        rules = rules.withColumn(
            name, F.expr(f"coalesce({name}, cast(array() AS {kind}))"))
    return rules


def built_in_catalog(spark: SparkSession) -> DataFrame:
    """The fixed rules as a constant relation, whose size Spark knows when it plans a join."""
    schema = "array<struct<" + ",".join(
        part.strip().replace(" ", ":", 1) for part in _split_fields(RULE_SCHEMA)) + ">>"
    return _with_defaults(spark.sql(
        f"SELECT inline(from_json({lit(json.dumps(RULES))}, {lit(schema)}))"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a JSON document ``{"rules": [...]}``."""
    document = "rules array<struct<" + ",".join(
        part.strip().replace(" ", ":", 1) for part in _split_fields(RULE_SCHEMA)) + ">>"
    rules = spark.read.schema(document).option("multiLine", True).json(path)
    return _with_defaults(rules.selectExpr("inline_outer(rules)").where("id IS NOT NULL"))


def _split_fields(schema: str) -> list[str]:
    fields, depth, current = [], 0, ""
    for char in schema:
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            fields.append(current)
            current = ""
        else:
            current += char
    return [*fields, current]


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Expected findings of a labelled corpus: (case, rule_id, line), one row per label.

    A case without expected findings keeps one row with a null rule, so that it is still known.
    """
    schema = "cases array<struct<path:string,expected:array<struct<rule_id:string,line:int>>>>"
    cases = spark.read.schema(schema).option("multiLine", True).json(path).selectExpr(
        "inline_outer(cases)")
    return cases.selectExpr("path AS case", "inline_outer(expected)").where("case IS NOT NULL")
