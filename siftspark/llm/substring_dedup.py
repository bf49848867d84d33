"""Repeated passages of words, found at difference-cover anchors.

A window is ``window`` words (13). Modulo the period 7 the places 1, 2 and 4 form a difference cover: for
any two places i and j there is a shift k below 7 with i + k and j + k both in the cover. So of two equal
windows, wherever they stand, some 7 words at the same offset start at a cover place in both texts, and it
is enough to hash 7 words at three places of seven.

1. Anchors. Each task emits the hashes of its cover places. Anchors that occur in two documents of one
   batch are known to be shared at once; they send on one row for all, so a passage that a third of all
   documents hold costs one row per batch. One shuffle by hash finds the other shared anchors.
2. Extension. Documents get their shared anchors back and extend each to the windows around it. Windows
   whose words also start in a smaller document of the batch are settled there; the first ones of each
   batch meet in a second shuffle by the hash of the whole window (80 bits).
3. Each document removes the words under its repeated windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.window import Window

from siftspark.llm.shared import mixed, ranges, words_of

PERIOD = 7
COVER = (1, 2, 4)
# Open rows are narrow, for there is one for three of seven words: 48 bits of the anchor's hash, which only
# picks candidates, share a number with the low bits of its place. A place that is known only modulo 65,536
# stands for all such places; it makes a few candidates more. A row without an id marks a hash as shared,
# one with runs holds places that are settled.
PLACE_BITS = 16
_GROUP_BYTES = 24_000_000
_STEPS = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_hashes(text: str) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words_of(text)], np.uint64)


def window_hashes(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of each ``size`` consecutive words."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, salt, np.uint64)
    words = mixed(words + np.uint64(salt))
    for j in range(size):
        out += words[j:j + n] * _STEPS[j]
    return mixed(out)


def groups_of(batches: Iterator[pa.RecordBatch], limit: int = _GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about ``limit`` bytes of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def runs_of(places: np.ndarray) -> np.ndarray:
    """Ascending places as start, length, start, length ..."""
    if not len(places):
        return np.zeros(0, np.int32)
    first = np.flatnonzero(np.r_[True, np.diff(places) > 1])
    lengths = np.diff(np.r_[first, len(places)])
    return np.stack([places[first], lengths], axis=1).astype(np.int32).ravel()


def places_of(runs: list[int] | np.ndarray) -> np.ndarray:
    pairs = np.asarray(runs, np.int64).reshape(-1, 2)
    return np.repeat(pairs[:, 0], pairs[:, 1]) + ranges(pairs[:, 1])


def settled_rows(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Documents, the runs of their places, and keys that spread them: a settled row meets nothing."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    if len(doc):  # rows that repeat an id may name a place twice
        fresh = np.r_[True, (np.diff(doc) != 0) | (np.diff(place) != 0)]
        doc, place = doc[fresh], place[fresh]
    owners, first = np.unique(doc, return_index=True)
    lists = [runs_of(x) for x in np.split(place, first[1:])] if len(owners) else []
    salt = np.uint64(int(place.sum()) & 0xFFFFFFFF)
    return owners, lists, mixed(owners.astype(np.uint64) * np.uint64(2654435761) + salt).view(np.int64)


def with_place(h: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The upper 48 bits of a hash with the low bits of a place."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    return ((h & ~low) | (pos.astype(np.uint64) & low)).view(np.int64)


def all_places(low: np.ndarray, n: int) -> np.ndarray:
    """Places below ``n`` with these low bits."""
    step = 1 << PLACE_BITS
    out = (np.asarray(low, np.int64)[:, None] + np.arange(0, max(n, 1), step)).ravel()
    return out[out < n]


HASH = f"shiftrightunsigned(hp, {PLACE_BITS})"
PLACE = f"cast(hp & {(1 << PLACE_BITS) - 1} AS int)"


def _ordered(ids: pa.Array) -> np.ndarray:
    """Ranks of the ids of a batch: equal ids have equal ranks."""
    return pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)


def anchor_rows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Anchors (hp, id, runs) of a batch: open ones by hash, a mark for each that the batch itself shows to be shared."""
    size = window - PERIOD + 1
    rank = _ordered(batch.column("id"))
    hashes, docs, places = [], [], []
    texts = batch.column("text")
    for k in range(batch.num_rows):
        h = window_hashes(word_hashes(texts[k].as_py()), size)
        at = np.flatnonzero(np.isin(np.arange(len(h)) % PERIOD, COVER))
        hashes.append(h[at])
        docs.append(np.full(len(at), k))
        places.append(at)
    h, doc, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, docs, places))
    h = h.astype(np.uint64)
    order = np.argsort(h, kind="stable")
    h, doc, pos = h[order], doc[order], pos[order]
    if len(h):
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        low, high = np.minimum.reduceat(rank[doc], first), np.maximum.reduceat(rank[doc], first)
        shared = np.repeat(low != high, np.diff(np.r_[first, len(h)]))
        mark = first[low != high]
    else:
        shared, mark = np.zeros(0, bool), np.zeros(0, np.int64)
    # In the order of the text: neighbouring rows of a shuffle file then differ little but for the hash.
    open_ = np.flatnonzero(~shared)
    open_ = open_[np.argsort(order[open_])]
    owners, runs, keys = settled_rows(doc[shared], pos[shared])
    ids = batch.column("id")
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([with_place(h[open_], pos[open_]), with_place(h[mark], np.zeros(len(mark), np.int64)), keys])),
        pa.concat_arrays([ids.take(pa.array(doc[open_])), pa.nulls(len(mark), ids.type), ids.take(pa.array(owners))]),
        pa.array([None] * (len(open_) + len(mark)) + runs, pa.list_(pa.int32())),
    ], ["hp", "id", "runs"])


def window_rows(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Windows (a, b, c, id, runs) around the shared anchors: settled where the batch holds a smaller document with the same."""
    rank = _ordered(batch.column("id"))
    texts, lists, singles = batch.column("text"), batch.column("lists"), batch.column("places")
    ones, twos, docs, places = [], [], [], []
    for k in range(batch.num_rows):
        words = word_hashes(texts[k].as_py())
        n = len(words) - window + 1
        anchors = np.concatenate([
            *(places_of(x) for x in lists[k].as_py()), all_places(singles[k].as_py(), len(words))])
        if n <= 0:
            continue
        near = np.zeros(n, bool)
        for shift in range(PERIOD):
            starts = anchors - shift
            near[starts[(starts >= 0) & (starts < n)]] = True
        at = np.flatnonzero(near)
        ones.append(window_hashes(words, window)[at])
        twos.append(window_hashes(words, window, 0x5BD1E995)[at] >> np.uint64(32))
        docs.append(np.full(len(at), k))
        places.append(at)
    h1, h2, doc, pos = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ones, twos, docs, places))
    h1, h2 = h1.astype(np.uint64), h2.astype(np.uint32)
    order = np.lexsort((h2, h1))
    h1, h2, doc, pos = h1[order], h2[order], doc[order], pos[order]
    if len(h1):
        first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        low = np.repeat(np.minimum.reduceat(rank[doc], first), np.diff(np.r_[first, len(h1)]))
        settled = rank[doc] > low
    else:
        settled = np.zeros(0, bool)
    open_ = np.flatnonzero(~settled)
    open_ = open_[np.argsort(order[open_])]
    owners, runs, keys = settled_rows(doc[settled], pos[settled])
    # 16 of the second hash's bits share a number with the low bits of the place; the rest is mostly zero.
    tail = ((h2[open_] << np.uint32(16)) | (pos[open_].astype(np.uint32) & np.uint32(0xFFFF))).view(np.int32)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([h1[open_].view(np.int64), keys])),
        pa.array(np.concatenate([tail, keys.astype(np.int32)])),
        pa.array(np.concatenate([pos[open_] >> 16, np.zeros(len(owners), np.int64)]).astype(np.int32)),
        batch.column("id").take(pa.array(np.concatenate([doc[open_], owners]).astype(np.int64))),
        pa.array([None] * len(open_) + runs, pa.list_(pa.int32())),
    ], ["a", "b", "c", "id", "runs"])


def by_document(rows: DataFrame) -> DataFrame:
    """(id, places, lists) of the rows that a document gets back."""
    return rows.groupBy("id").agg(
        F.collect_list(F.when(F.col("runs").isNull(), F.col("pos"))).alias("places"),
        F.collect_list("runs").alias("lists"))


def repeated_windows(source: DataFrame, window: int) -> DataFrame:
    """(id, places, lists): starts of windows whose words also start in a document with a smaller id.

    ``source`` has the columns id (no nulls) and text (no nulls).
    """
    kind = source.schema["id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches):
            yield anchor_rows(batch, window)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches):
            yield window_rows(batch, window)

    # Dealt by an expression over the packed number, so that the rows carry nothing but it.
    found = source.mapInArrow(anchors, f"hp bigint, id {kind}, runs array<int>").repartition(F.expr(HASH))
    same = Window.partitionBy("h")
    open_id = F.when(F.col("runs").isNull(), F.col("id"))
    mark = F.col("runs").isNull() & F.col("id").isNull()
    shared = found.selectExpr("id", f"{PLACE} AS pos", "runs", f"{HASH} AS h").select(
        "id", "pos", "runs", F.min(open_id).over(same).alias("low"), F.max(open_id).over(same).alias("high"),
        F.max(mark).over(same).alias("mark"),
    ).filter("runs IS NOT NULL OR id IS NOT NULL AND (low <> high OR mark)")
    joined = source.join(by_document(shared), "id")
    extended = joined.mapInArrow(windows, f"a bigint, b int, c int, id {kind}, runs array<int>").repartition(
        F.col("a"), F.expr("shiftrightunsigned(b, 16)"))
    same = Window.partitionBy("a", "g")
    repeated = extended.selectExpr(
        "a", "shiftrightunsigned(b, 16) AS g", "id", "shiftleft(c, 16) | (b & 65535) AS pos", "runs").select(
        "id", "pos", "runs", F.min(open_id).over(same).alias("low")).filter("runs IS NOT NULL OR low < id")
    return by_document(repeated)


def deduplicated(
    docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
    carry: bool = False,
) -> DataFrame:
    """(id_col, n_words, n_removed, kept string) for each row; with ``digests`` the SHA-256 of ``kept``.

    With ``carry`` a column ``rest`` holds the row's own columns but id and text.

    Removed is each word under a window whose words also start in a document with a smaller id; windows
    are judged on the input. ``kept`` joins the other words by one space where anything was removed and is
    the text itself otherwise; its digest is always over the words joined by one space. Null and empty
    texts have no words. Rows that repeat an id are one document: none repeats the other, and what is
    removed at a place of one is removed in all. Rows with a null id neither remove nor lose words. Other
    columns are ignored; an empty table gives an empty result. ``window`` is at least 7.
    """
    if window < PERIOD:
        raise ValueError(f"windows have at least {PERIOD} words")
    others = [f"`{c}`" for c in docs.columns if c not in (id_col, text_col)]
    rest = [f"named_struct({', '.join(f"'{c[1:-1]}', {c}" for c in others) or "'none', 0"}) AS rest"] if carry else []
    plain = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text", *rest)
    source = plain.filter("id IS NOT NULL")
    removed = repeated_windows(source, window)
    more = ["rest"] if carry else []
    rows = source.join(removed, "id", "left").select("id", "text", *more, "places", "lists").union(
        plain.filter("id IS NULL").selectExpr(
            "id", "text", *more, "cast(NULL AS array<int>)", "cast(NULL AS array<array<int>>)"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches):
            total, gone, kept = [], [], []
            texts, lists, singles = batch.column("text"), batch.column("lists"), batch.column("places")
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                words = words_of(text)
                starts = np.concatenate([
                    *(places_of(x) for x in lists[k].as_py() or []), np.array(singles[k].as_py() or [], np.int64)])
                total.append(len(words))
                if len(starts):
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, np.minimum(starts + window, len(words)), -1)
                    stays = np.cumsum(edges[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                gone.append(total[-1] - len(words))
                if digests:
                    kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    kept.append(b" ".join(words).decode() if gone[-1] else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                 *(batch.column(c) for c in more)], ["id", "n_words", "n_removed", name, *more])

    name = "kept_sha256" if digests else "kept"
    schema = ST.StructType([
        plain.schema["id"], ST.StructField("n_words", ST.LongType()), ST.StructField("n_removed", ST.LongType()),
        ST.StructField(name, ST.StringType()), *(plain.schema[c] for c in more)])
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, texts without their repeated windows. Null texts become empty."""
    found = deduplicated(docs, window, id_col, text_col, carry=True)
    return found.selectExpr(*(
        f"`{id_col}`" if c == id_col else f"kept AS `{c}`" if c == text_col else f"rest.`{c}` AS `{c}`" for c in docs.columns))
