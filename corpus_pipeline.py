"""A training corpus from raw documents: stages that each take all their predecessor kept.

``STAGES`` lists them; ``run`` applies them in order to ``documents`` and writes each result as Parquet in
the shared folder, from where the next stage reads it. All but the last return the columns of documents;
``n_chars`` follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftspark.llm import packing, queries, secret_scan, simhash, substring_dedup, toxicity
from siftspark.llm.shared import written

ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has them, in the type it had."""
    kind = dict(docs.dtypes).get("n_chars")
    if kind is None:
        return docs
    return docs.selectExpr(*(
        f"cast(char_length(text) AS {kind}) AS n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on ``labels``, does not reject."""
    model = toxicity.fitted(docs, queries.table(spark, sf_dir, "labels"), "toxic")
    return toxicity.without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of three-word shingles differ in at most two bits."""
    return simhash.without_near_duplicates(docs, shingle=3, distance=2)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words under 13-word windows that also start in a document with a smaller id."""
    return _counted(substring_dedup.without_repeats(docs, window=13))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with all secrets masked."""
    return _counted(secret_scan.without_secrets(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.packed(docs, queries.WORDS, end_id=2, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_of_toxicity),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("secret_scans", secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
