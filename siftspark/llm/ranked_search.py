"""Ranked lexical search of all documents for a set of items, with deduplicated bags of terms.

Only an item's terms can score, so each document is restricted to the items' vocabulary: its bag is the
counts of these terms and the integer ``m`` that stands for its length. Documents with the same bag have the
same score for every item.

1. One pass over the texts writes each document's length and restricted bag. The number of documents with
   terms, their total length and the documents that hold each term follow from it; the sums are made in the
   tasks, so the driver gets one number for each term of the vocabulary.
2. Bags are grouped by a hash of counts and ``m``, verified by the counts themselves: a class is what is
   equal in full. Copies collapse in the tasks before the shuffle.
3. Each class is scored once for all items. A task keeps the best ``k`` classes of each item, by score and
   smallest id; no class beyond these can hold one of the best ``k`` documents.
4. The classes chosen are expanded again: of each the ``k`` smallest ids, of each item the ``k`` best.

Items come in blocks of at most about ``BLOCK_TERMS`` terms, so the vocabulary that travels with the tasks is
bounded however many items there are; each block meets all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.llm.shared import keyed_text, ranges, written

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
BLOCK_TERMS = 500_000
_PIECE = 1 << 20
_ROWS = 1_000
_EXPANDED = 2_000_000  # postings of items that are added up at once
_CELLS = 1_000_000  # scores that are held at once
# Sums are made in doubles, which hold whole numbers below this exactly.
_EXACT = 1 << 53


def bag(text: str) -> Counter:
    """Terms and their counts in a whole text; A-Z lower-cased."""
    data = text.encode("utf-8", "surrogatepass").lower()
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = BREAK.search(data, min(at + _PIECE, len(data)))
        stop = end.start() if end else len(data)
        found.update(TERM.findall(data, at, stop))
        at = max(stop, at + 1)
    return found


@dataclass(frozen=True)
class Items:
    """A block of items: their ids, the vocabulary in order, and the items of each of its terms."""

    ids: pa.Array
    terms: list[bytes]
    starts: np.ndarray
    postings: np.ndarray


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[Items]:
    """Items with a term, in blocks by a hash of their number, each sent to the driver alone."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(bag(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(terms, pa.list_(pa.binary()))], ["id", "terms"])

    source = keyed_text(items, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    lists = written(source.mapInArrow(cut, f"id {kind}, terms array<binary>").filter("size(terms) > 0"), "items")
    total = lists.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = math.ceil(total / block_terms)
    for k in range(n):
        rows = lists.filter(F.expr(f"pmod(xxhash64(id, terms), {n}) = {k}")).toArrow()
        rows = rows.sort_by("id").combine_chunks()
        if not rows.num_rows:
            continue
        terms = rows.column("terms").combine_chunks()
        words = [w.as_py() for w in terms.flatten()]
        vocabulary = sorted(set(words))
        place = {w: i for i, w in enumerate(vocabulary)}
        term = np.array([place[w] for w in words], np.int64)
        item = np.repeat(np.arange(rows.num_rows), pc.list_value_length(terms).to_numpy())
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
        yield Items(rows.column("id").combine_chunks(), vocabulary, starts, item[order])


def restricted(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of the documents with at least one term; ``terms`` ascending places in the vocabulary."""
    known = {w: k for k, w in enumerate(vocabulary)}

    def of(text: str) -> tuple[int, np.ndarray, np.ndarray]:
        found = bag(text)
        own = [(known[w], c) for w, c in found.items() if w in known]
        pairs = np.array(own, np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        return found.total(), pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [of(t.as_py()) for t in part.column("text")]
                ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array([r[0] for r in rows], pa.int64()),
                    pa.ListArray.from_arrays(ends, np.concatenate([r[1] for r in rows]).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, np.concatenate([r[2] for r in rows])),
                ], ["id", "n", "terms", "counts"])

    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n bigint, terms array<int>, counts array<bigint>").filter("n > 0")


def documents_with(bags: DataFrame, size: int) -> np.ndarray:
    """For each term of the vocabulary the number of documents that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["term", "docs"])

    sums = bags.select("terms").mapInArrow(run, "term bigint, docs bigint").groupBy("term").agg(F.sum("docs").alias("docs"))
    out = np.zeros(size, np.int64)
    for row in sums.collect():
        out[row["term"]] = row["docs"]
    return out


def weights(n: int, docs: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in docs], np.int64)


def scores(
    starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, m: np.ndarray, weight: np.ndarray, items: Items,
) -> np.ndarray:
    """Scores of some classes (rows) for all items; the bag of row ``r`` lies at ``starts[r]:starts[r + 1]``."""
    width = len(items.ids)
    row = np.repeat(np.arange(len(m)), np.diff(starts))
    part = weight[terms] * ((1_000_000_000 * counts) // (1_000 * counts + 20 * m[row]))
    times = items.starts[terms + 1] - items.starts[terms]
    out = np.zeros(len(m) * width)
    ends = np.cumsum(times)
    at = 0
    while at < len(terms):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + _EXPANDED, side="right")))
        own = slice(at, stop)
        cell = np.repeat(row[own] * width, times[own]) + items.postings[np.repeat(items.starts[terms[own]], times[own]) + ranges(times[own])]
        out += np.bincount(cell, weights=np.repeat(part[own], times[own]).astype(np.float64), minlength=len(out))
        at = stop
    return out.reshape(len(m), width).astype(np.int64)


class Best:
    """The ``k`` best classes of each item so far: highest score, then smallest id, null ids last."""

    def __init__(self, width: int, k: int):
        self.k, self.least, self.held, self.count = k, np.zeros(width, np.int64), [], 0

    def add(self, found: np.ndarray, first: pa.Array, classes: np.ndarray) -> None:
        row, item = np.nonzero((found > 0) & (found >= self.least))
        self.held.append(pa.table({
            "item": item, "score": found[row, item], "first": first.take(pa.array(row)), "class": classes[row]}))
        self.count += len(row)
        if self.count > 4 * self.k * len(self.least):
            self.close()

    def close(self) -> pa.Table | None:
        if not self.held:
            return None
        table = pa.concat_tables(self.held).combine_chunks()
        order = pc.sort_indices(table, sort_keys=[("item", "ascending"), ("score", "descending"), ("first", "ascending")])
        table = table.take(order)
        item = table.column("item").to_numpy()
        begun = np.searchsorted(item, np.arange(len(self.least) + 1))
        kept = np.arange(len(item)) - begun[item] < self.k
        full = np.flatnonzero(np.diff(begun) >= self.k)
        self.least[full] = table.column("score").to_numpy()[begun[full] + self.k - 1]
        table = table.filter(pa.array(kept))
        self.held, self.count = [table], table.num_rows
        return table


def best_classes(classes: DataFrame, items: Items, weight: np.ndarray, k: int) -> DataFrame:
    """(item, score, first, class): of each task's classes the best ``k`` for each item."""
    kind = classes.schema["first"].dataType.simpleString()
    # A part is below the weight times a million; no item has more terms than the vocabulary.
    if len(weight) and int(weight.max()) * 1_000_000 * len(weight) >= _EXACT:
        raise ValueError("scores of items this long don't fit into whole numbers of doubles; take smaller blocks of items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items.ids), k)
        step = max(1, _CELLS // len(items.ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                terms, counts = part.column("terms"), part.column("counts")
                starts = np.r_[0, np.cumsum(terms.value_lengths().to_numpy())]
                found = scores(starts, terms.flatten().to_numpy(), counts.flatten().to_numpy(), part.column("m").to_numpy(), weight, items)
                best.add(found, part.column("first"), part.column("class").to_numpy())
        table = best.close()
        if table is not None:
            yield from table.select(["item", "score", "first", "class"]).to_batches(max_chunksize=10_000)

    return classes.select("first", "class", "m", "terms", "counts").mapInArrow(
        run, f"item bigint, score bigint, first {kind}, class bigint")


def _firsts(rows: DataFrame, keys: list[str], order: list, k: int, name: str = "place") -> DataFrame:
    """The first ``k`` rows of each key; Spark cuts each task's rows of a key to ``k`` before it shuffles them."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def _ranked_block(docs: DataFrame, items: Items, k: int, id_col: str, text_col: str) -> DataFrame:
    bags = written(restricted(docs, items.terms, id_col, text_col), "bags")
    known = bags.agg(F.count("*"), F.sum(F.col("n").cast("decimal(38,0)"))).first()
    n, length = known[0], int(known[1] or 0)
    weight = weights(n, documents_with(bags, len(items.terms)))
    m = f"50 + cast((cast(50L * n AS decimal(38,0)) * {n}BD) div {max(length, 1)}BD AS bigint)"
    keyed = bags.filter("size(terms) > 0").selectExpr("id", "terms", "counts", f"{m} AS m").selectExpr(
        "*", "xxhash64(m, terms, counts) AS hash")
    # A number for each class, given once and written with it.
    classes = written(keyed.groupBy("hash", "m", "terms", "counts").agg(F.min("id").alias("first")).withColumn(
        "class", F.monotonically_increasing_id()), "classes")
    best = _firsts(best_classes(classes, items, weight, k), ["item"],
                   [F.desc("score"), F.asc_nulls_last("first"), F.asc("class")], k).drop("place", "first")
    best = written(best, "best_classes")
    chosen = classes.join(best.select("class").distinct(), "class", "left_semi").select("class", "hash", "m", "terms", "counts")
    members = keyed.alias("d").join(chosen.alias("c"), [F.col(f"d.{x}") == F.col(f"c.{x}") for x in ("hash", "m", "terms", "counts")])
    members = _firsts(members.select("class", "id"), ["class"], [F.asc_nulls_last("id")], k).drop("place")
    ranked = _firsts(best.join(members, "class"), ["item"], [F.desc("score"), F.asc_nulls_last("id")], k, "rank")
    # The place of an item becomes its id again in the tasks.
    ids = items.ids

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ids.take(batch.column("item"))
            yield pa.RecordBatch.from_arrays([own, *(batch.column(c) for c in ("rank", "id", "score"))], ["item_id", "rank", "id", "score"])

    kind = bags.schema["id"].dataType.simpleString()
    item_kind = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string"}[ids.type]
    return ranked.select("item", "rank", "id", "score").mapInArrow(
        named, f"item_id {item_kind}, rank int, id {kind}, score bigint")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_col, rank, id_col, score): each item's ``k`` best documents with a score above 0, or all if fewer.

    Terms are runs of digits, letters and everything outside ASCII, A-Z lower-cased, of the whole texts; null
    and empty texts have none and never rank. Equal scores rank by ascending id, null ids last; equal ids too
    are told apart by rank, in no fixed order. Each row of ``docs`` counts as a document and each row of
    ``items`` with a term as an item, repeats included: items of one id and one text rank alike, once for each
    row. Items without terms, empty tables and documents without an item's terms give no rows. Other columns
    are ignored. Ids are whole numbers or strings.
    """
    if not 1 <= k <= 1_000:
        raise ValueError("k is 1 to 1,000: only so many rows of a key are cut off before the shuffle")
    parts = [_ranked_block(docs, block, k, id_col, text_col) for block in item_blocks(items, item_col, item_text, block_terms)]
    if not parts:
        kinds = (items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString())
        parts = [docs.sparkSession.createDataFrame([], f"item_id {kinds[0]}, rank int, id {kinds[1]}, score bigint")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.withColumnsRenamed({"item_id": item_col, "id": id_col})
