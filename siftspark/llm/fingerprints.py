"""Document fingerprints: one-permutation MinHash with optimal densification, in built-in expressions.

Each shingle of five words is hashed once; the top bits of the hash are its bin, and the least hash of a
bin is kept. An empty bin copies another: it tries bins in a random order of its own, the same for every
document, until one is filled, so two documents that fill the same bins copy alike. Of each bin four low
bits are stored, as one hex digit: those of a hash of its value and its own number, so that the bins that
copy one value agree by chance each on its own. The share of equal digits is corrected for chance hits.
Everything about a document is an array expression over its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.functions.sql import let
from siftspark.llm.shared import mixed, written

BINS = 256
SHINGLE = 5
PROBES = 8
BITS = 4
BREAKS = r"r'[\x20\x09-\x0D]+'"


def _orders() -> list[list[int]]:
    """For each of the first probes, the bin that each bin tries."""
    import numpy as np

    keys = np.arange(PROBES * BINS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    return (mixed(keys) % np.uint64(BINS)).astype(int).reshape(PROBES, BINS).tolist()


def _int_array(values: list[int]) -> str:
    return f"array({', '.join(map(str, values))})"


def _packed(kept: str) -> str:
    """SQL: hex digits of all bins from the ascending least hashes of the filled ones."""
    def of_bins(bins: str) -> str:
        tries = ", ".join(
            f"get({kept}, cast(array_position({bins}, get({_int_array(order)}, j)) AS int) - 1)" for order in _orders())
        # Later tries: the filled bin that comes first in a hashed order of this bin's own.
        last = (f"array_min(transform({kept}, v -> named_struct("
                f"'o', xxhash64(j, shiftrightunsigned(v, 56)), 'v', v))).v")
        return (f"array_join(transform(sequence(0, {BINS - 1}), j -> lower(hex(xxhash64(j, coalesce("
                f"get({kept}, cast(array_position({bins}, j) AS int) - 1), {tries}, {last})) & 15))), '')")
    return let(f"transform({kept}, v -> cast(shiftrightunsigned(v, 56) AS int))", of_bins)


def fingerprint(text: str) -> str:
    """SQL: the fingerprint of a text that is not null."""
    # filter() takes the place along, so a run's first hash is told from its neighbour.
    def least(s: str) -> str:
        return f"filter({s}, (v, k) -> k = 0 OR shiftrightunsigned(v, 56) <> shiftrightunsigned(get({s}, k - 1), 56))"

    def shingles(h: str) -> str:
        return (f"if(size({h}) >= {SHINGLE}, transform(sequence(0, size({h}) - {SHINGLE}), i -> xxhash64("
                + ", ".join(f"get({h}, i + {k})" for k in range(SHINGLE)) + f")), array(xxhash64({h})))")

    words = f"transform(filter(split({text}, {BREAKS}), w -> w <> ''), w -> xxhash64(w))"
    return let(words, lambda h: let(f"sort_array({shingles(h)})", lambda s: let(least(s), _packed)))


def likeness(a: str, b: str) -> str:
    """SQL: the estimated share of common shingles of two fingerprints, 0 to 1, free of chance hits."""
    equal = f"size(filter(sequence(1, {BINS}), i -> substring({a}, i, 1) = substring({b}, i, 1)))"
    chance = 1 / (1 << BITS)
    return f"greatest(0D, ({equal} / {BINS}D - {chance}D) / {1 - chance}D)"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) for each row. A text of fewer than five words is one shingle, none included."""
    return docs.selectExpr(f"`{id_col}`", f"{fingerprint(f"coalesce(`{text_col}`, '')")} AS fingerprint")


def neighbours(keys: DataFrame) -> DataFrame:
    """(id, th, n, next_id, next_th): the next row by descending id, the first behind the last.

    Rows are ranged by id over the tasks and numbered there; only one row per range meets its neighbours.
    """
    ranged = written(
        keys.repartitionByRange(F.col("id").desc_nulls_last(), F.col("th").asc()).withColumn("part", F.spark_partition_id()),
        "order")
    inside = Window.partitionBy("part").orderBy(F.col("id").desc_nulls_last(), "th")
    own = ranged.select("*", F.lead(F.struct("id", "th")).over(inside).alias("following"))
    # The bounded table of ranges: its first rows, each handed to the range before it.
    firsts = ranged.groupBy("part").agg(F.min_by(F.struct("id", "th"), F.struct(
        F.col("id").isNull(), -F.col("id"), F.col("th"))).alias("first"))
    over = Window.orderBy("part")
    whole = over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("part", F.coalesce(F.lead("first").over(over), F.first("first").over(whole)).alias("after"))
    return own.join(F.broadcast(after), "part").select(
        "id", "th", "n", F.coalesce("following", "after").alias("f")).select(
        "id", "th", "n", F.col("f.id").alias("next_id"), F.col("f.th").alias("next_th"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text ends, instead of in its own last floor(n_chars / 3) characters, in the first as many
    of the next document by descending id (the first document behind the last). Null texts are empty. Rows
    that repeat id and text are one document, returned as often; rows with one id and several texts follow
    each other in the order of a hash. Rows with a null id come last. Ids are integers. Other columns are
    ignored; an empty table gives an empty result. Texts are shuffled once.
    """
    source = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text").selectExpr(
        "id", "text", "xxhash64(text) AS th")
    keys = source.selectExpr("id", "th", "char_length(text) AS n").groupBy("id", "th").agg(
        F.max("n").alias("n"), F.count("*").alias("copies"))
    order = written(neighbours(keys.select("id", "th", "n")), "neighbours")
    # From here on a document's key holds no null: what is grouped by it lies as the joins need it, and moves once.
    key, next_key = ["k", "gone", "th"], ["next_k", "next_gone", "next_th"]

    def keyed(df: DataFrame, *more: str) -> DataFrame:
        return df.selectExpr("coalesce(id, 0) AS k", "id IS NULL AS gone", "th", *more)
    texts = keyed(source, "text")
    step = keyed(order, "coalesce(next_id, 0) AS next_k", "next_id IS NULL AS next_gone", "next_th", "cast(floor(n / 3) AS int) AS m")
    asked = step.selectExpr("next_k AS k", "next_gone AS gone", "next_th AS th", "k AS for_k", "gone AS for_gone", "th AS for_th", "m")
    heads = texts.join(asked, key).selectExpr(
        "for_k AS k", "for_gone AS gone", "for_th AS th", "substring(text, 1, m) AS head").groupBy(key).agg(
        F.first("head").alias("head"))
    edited = texts.join(heads, key).selectExpr(
        *key, "text", "concat(substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) AS int)), head) AS edited")
    # Digits are kept and moved as bytes.
    printed = written(edited.selectExpr(
        *key, "cast(char_length(text) AS bigint) AS n_chars", "unhex(sha2(edited, 256)) AS edited_sha256",
        f"unhex({fingerprint('text')}) AS fingerprint", f"unhex({fingerprint('edited')}) AS edited_fingerprint"), "printed")
    of_next = printed.groupBy(*(F.col(k).alias(n) for k, n in zip(key, next_key))).agg(
        F.first("fingerprint").alias("next_fingerprint"))
    of_next = step.select(*key, *next_key).join(of_next, next_key).select(*key, "next_fingerprint")
    digits = ("edited_sha256", "fingerprint", "edited_fingerprint")
    return printed.join(of_next, key).selectExpr(
        "CASE WHEN NOT gone THEN k END AS id", "n_chars", *[f"lower(hex({d})) AS {d}" for d in digits], "next_fingerprint").select(
        F.col("id").alias(id_col), "n_chars", *digits,
        F.expr(likeness("fingerprint", "edited_fingerprint")).alias("near_edited"),
        F.expr(let("lower(hex(next_fingerprint))", lambda n: likeness("fingerprint", n))).alias("near_next"))
