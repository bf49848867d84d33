"""Toxicity by subword bags: character n-gram embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (and of itself), a text the mean of its words,
and a linear softmax over that mean gives the score. Both are trained jointly in numpy on a bounded
sample of labelled rows. An unseen misspelling shares most n-grams, and so most of its vector, with the
word it distorts. For scoring, the vector of a bucket matters only through its product with the
difference of both class weights, so a model is one number per bucket and travels with the tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.shared import keyed_text, mixed

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
DIM = 4
EPOCHS = 100
MIN_TEXTS = 4
PRIOR_WORDS = 8  # neutral words added to each text, so that very short ones stay near the base rate
DECAY = 1e-6
STEP = 4.0
MAX_ROWS = 6_000
CACHED_WORDS = 100_000
# What a worker holds besides its batch: the words of so much text, the n-grams of so many words.
SLICE_BYTES = 1 << 20
SLICE_WORDS = 8_000
_EDGES = b".,;:!?\"'()[]{}|"
_STEPS = mixed(np.arange(1, max(SIZES) + 1, dtype=np.uint64)) | np.uint64(1)


def words(text: str) -> list[bytes]:
    """Lower-cased runs without white space, outer punctuation taken off."""
    return [w for w in (x.strip(_EDGES) for x in text.lower().encode("utf-8", "surrogatepass").split()) if w]


def subwords(distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of all n-grams and whole words, sorted by word."""
    spelled = [f"<{w.decode('utf-8', 'surrogatepass')}>" for w in distinct]
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    points = np.frombuffer("".join(spelled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(spelled)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # characters to the word's end
    buckets, owners = [], []
    for n in SIZES:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = mixed(h + points[at + j] * _STEPS[j])
        buckets.append(h % np.uint64(BUCKETS))
        owners.append(word[at])
    h = np.zeros(len(spelled), np.uint64)
    if len(points):
        place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        h = np.add.reduceat(mixed(points * np.uint64(1_000_003) + place.astype(np.uint64)), np.cumsum(lengths) - lengths)
    buckets.append(mixed(h) % np.uint64(BUCKETS))
    owners.append(np.arange(len(spelled)))
    bucket, owner = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # per bucket
    bias: float

    def of_words(self, distinct: list[bytes]) -> np.ndarray:
        if not distinct:
            return np.zeros(0)
        bucket, owner = subwords(distinct)
        n = np.bincount(owner, minlength=len(distinct))
        return np.bincount(owner, self.weights[bucket], minlength=len(distinct)) / n

    def scores(self, texts: list[str], cache: dict[bytes, float]) -> list[float]:
        if len(cache) > CACHED_WORDS:
            cache.clear()
        split = [words(t) for t in texts]
        new = list(dict.fromkeys(itertools.filterfalse(cache.__contains__, itertools.chain.from_iterable(split))))
        for at in range(0, len(new), SLICE_WORDS):
            part = new[at:at + SLICE_WORDS]
            cache.update(zip(part, self.of_words(part).tolist(), strict=True))
        means = np.array([sum(map(cache.__getitem__, w)) / (len(w) + PRIOR_WORDS) for w in map(set, split)])
        return (1 / (1 + np.exp(-np.clip(means + self.bias, -500, 500)))).tolist()


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs that begin in the same ``SLICE_BYTES`` of text; a run has a row at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(lengths) - lengths) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
    yield from ((at, end - at) for at, end in itertools.pairwise([*starts, len(part)]))


class _Sums:
    """Sums of rows of a table by group: ``out[group] = sum of factor * table[row]``, and its transpose."""

    def __init__(self, group: np.ndarray, row: np.ndarray, factor: np.ndarray, n_groups: int, n_rows: int):
        self.ways = []
        for key, other, n in ((group, row, n_groups), (row, group, n_rows)):
            order = np.argsort(key, kind="stable")
            filled, first = np.unique(key[order], return_index=True)
            self.ways.append((other[order], factor[order].astype(np.float32)[:, None], filled, first, n))

    def __call__(self, table: np.ndarray, back: bool = False) -> np.ndarray:
        row, factor, filled, first, n = self.ways[back]
        out = np.zeros((n, table.shape[1]), np.float32)
        if len(first):
            out[filled] = np.add.reduceat(table[row] * factor, first)
        return out


def fit(
    texts: list[str], labels: list[int], base_rate: float | None = None, epochs: int = EPOCHS, seed: int = 7,
) -> Model:
    """Train on texts with labels 0 or 1. Without both classes, the score is the (smoothed) base rate.

    ``base_rate`` is the share of label 1 where the texts are drawn by class; the scores follow it.
    """
    y = np.array(labels, np.float32)
    rate = (float(y.sum()) + 1) / (len(y) + 2)
    base_rate = base_rate or rate
    shift = float(np.log(base_rate / (1 - base_rate)) - np.log(rate / (1 - rate)))
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))) + shift)
    index: dict[bytes, int] = {}
    docs, ids, counts = [], [], []
    for k, text in enumerate(texts):
        found = words(text)
        held = sorted(set(found))
        docs.append(np.full(len(held), k))
        ids.append(np.array([index.setdefault(w, len(index)) for w in held], np.int64))
        counts.append(np.full(len(held), 1 / (len(held) + PRIOR_WORDS), np.float32))
    doc, word, share = np.concatenate(docs), np.concatenate(ids), np.concatenate(counts)
    kept = np.bincount(word, minlength=len(index)) >= MIN_TEXTS
    names = [w for w, k in zip(index, kept.tolist(), strict=True) if k]
    doc, word, share = doc[kept[word]], (np.cumsum(kept) - 1)[word[kept[word]]], share[kept[word]]
    if not names:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(rate / (1 - rate))) + shift)
    bucket, owner = subwords(names)
    sizes = np.bincount(owner, minlength=len(names))
    used, bucket = np.unique(bucket, return_inverse=True)
    to_docs = _Sums(doc, word, share, len(y), len(names))
    to_words = _Sums(owner, bucket, 1 / sizes[owner], len(names), len(used))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    linear = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - rate, rate], np.float32))
    target = np.stack([1 - y, y], axis=1)
    state = [np.zeros_like(p) for p in (vectors, linear, bias)]
    for epoch in range(1, epochs + 1):
        mean = to_docs(to_words(vectors))
        logits = mean @ linear + bias
        logits -= logits.max(axis=1, keepdims=True)
        soft = np.exp(logits)
        soft /= soft.sum(axis=1, keepdims=True)
        error = (soft - target) / len(y)
        grads = (to_words(to_docs(error @ linear.T, back=True), back=True) + DECAY * vectors,
                 mean.T @ error + DECAY * linear, error.sum(axis=0))
        # One step size for all vectors, so that buckets with a large gradient lead; momentum smooths it.
        for p, g, m, rate in zip((vectors, linear, bias), grads, state, (STEP, STEP, 0.05), strict=True):
            norm = float(np.sqrt((g * g).sum())) + 1e-12
            m *= 0.8
            m += 0.2 * g / norm * min(1.0, 4 * (1 - epoch / (epochs + 1)))
            p -= rate * m
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = vectors @ (linear[:, 1] - linear[:, 0])
    return Model(weights, float(bias[1] - bias[0]) + shift)


def fitted(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = MAX_ROWS, epochs: int = EPOCHS,
) -> Model:
    """A model from at most ``max_rows`` labelled rows, half of each class, those with the smallest hashes.

    Rows without a label or text are passed over; of several labels of an id the largest holds. The ids of
    the sample are bounded by ``max_rows`` and so are broadcast; its whole texts go to the driver. The base
    rate is counted over all labels.
    """
    known = (
        labels.selectExpr(f"`{id_col}` AS id", f"`{label_col}` AS label").filter("label IN (0, 1) AND id IS NOT NULL")
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    counts = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}
    rate = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    first, second = (
        known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(max_rows // 2) for label in (0, 1))
    chosen = F.broadcast(first.union(second))
    rows = keyed_text(docs, id_col, text_col).join(chosen, "id").select("id", "label", "text").collect()
    rows.sort(key=lambda r: (r["id"], r["text"]))
    return fit([r["text"] for r in rows], [int(r["label"]) for r in rows], rate, epochs)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for each row, 0 to 1.

    Null and empty texts get the score of a text without words. Rows that repeat get the same score; null
    ids stay null; other columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in batches:
            texts, column = batch.column("text"), []
            for at, n in _slices(texts):
                column += model.scores(texts.slice(at, n).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(column, pa.float64())], ["id", "score"])

    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose score is below ``limit``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for at, n in _slices(texts):
                scores = model.scores([t or "" for t in texts.slice(at, n).to_pylist()], cache)
                yield batch.slice(at, n).filter(pa.array([x < limit for x in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
