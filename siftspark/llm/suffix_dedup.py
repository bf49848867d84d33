"""Repeated byte strings by a hash-compared suffix sort.

Suffixes are compared through their longest common extension: prefix polynomial hashes tell in one step
whether two suffixes agree over any length, and a binary search over the length finds where they part. A
merge sort with these comparisons orders suffixes; neighbours that agree over ``length`` bytes are the
same string, which the bytes themselves then confirm.

A suffix array of the whole corpus would be one global sort of all bytes. Here suffixes that can be equal
over ``length`` bytes meet in groups instead. Of the 32-byte grams in a string of 100 bytes the one with the
least hash is its anchor; equal strings have the same anchor at the same offset.

1. Each task sends the anchors of its documents by hash (nearly 3 in 100 bytes). An anchor that one batch
   holds ``LOCAL_CROWD`` times is crowded and costs one row. One shuffle finds the repeated anchors.
2. Documents get theirs back. Neighbouring strings with one anchor are a segment. Within the batch, segments
   are suffix-sorted over their whole length first, so that each of a kind is one comparison and not one a
   string; where different segments share an anchor, the strings of the earliest of each kind are sorted
   too. Strings that also start earlier in the batch are settled, others travel as segments to the group of
   their anchor, where the same is done.
3. A crowded anchor (a third of all documents may share a line), also one that occurs more than ``CROWD``
   times in all, forms no group: its strings, those first in their batch only, are dealt anywhere and meet
   by their own hash (96 bits), a row for each distinct string of a batch.
4. Each document drops the bytes under its repeated strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftspark.llm.shared import mixed, ranges, whole_groups
from siftspark.llm.substring_dedup import (
    HASH,
    PLACE,
    PLACE_BITS,
    all_places,
    by_document,
    groups_of,
    places_of,
    with_place,
)

LENGTH = 100
GRAM = 32
CROWD = 2_000
LOCAL_CROWD = 16
_BATCH_BYTES = 3_000_000
_BLOCK = 1 << 15  # places whose windows are taken together
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n + n // 4, x, np.uint64)]) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


class Suffixes:
    """Bytes with prefix hashes, so that any two substrings are compared in one step."""

    def __init__(self, data: np.ndarray):
        self.data = data
        power, self.inverse = _power_tables(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[:len(data)], out=self.prefix[1:])

    def hashes(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.prefix[at + length] - self.prefix[at]) * self.inverse[at]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at ``a`` and ``b``, up to ``most`` bytes."""
        out = np.where(self.hashes(a, most) == self.hashes(b, most), most, 0)
        apart = np.flatnonzero(out == 0)
        a, b = a[apart], b[apart]
        low, high = np.zeros(len(a), np.int64), most[apart]  # agree over low, not over high
        before_a, before_b, turn_a, turn_b = self.prefix[a], self.prefix[b], self.inverse[a], self.inverse[b]
        while len(a) and (high - low).max() > 1:
            middle = (low + high) // 2
            same = (self.prefix[a + middle] - before_a) * turn_a == (self.prefix[b + middle] - before_b) * turn_b
            low, high = np.where(same, middle, low), np.where(same, high, middle)
        out[apart] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        common = self.extension(a, b, most)
        whole = common >= most
        rest = np.minimum(common, most - 1)
        return np.where(whole, or_equal, self.data[a + rest] < self.data[b + rest])

    def confirmed(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the bytes are equal, compared in words of eight (the last one may overlap)."""
        out = np.zeros(len(a), bool)
        words = np.ndarray(max(0, len(self.data) - 7), "<u8", self.data, strides=(1,))
        for k in range(0, len(a), 100_000):
            part = slice(k, k + 100_000)
            steps = np.minimum(np.arange(0, length[part].max(), 8), length[part, None] - 8)
            out[part] = (words[a[part, None] + steps] == words[b[part, None] + steps]).all(axis=1)
        return out

    def sorted_in_groups(self, at: np.ndarray, first: np.ndarray, sizes: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Merge sort of each group of suffixes (``at[first:first + size]``), all groups in step, stable.

        ``most`` is the length that counts, for each group.
        """
        at = at.copy()
        width = 1
        while len(sizes) and width < sizes.max():
            large = sizes > width  # smaller groups are in order
            first, sizes, most = first[large], sizes[large], most[large]
            place = ranges(sizes)
            whole = np.repeat(most, sizes)
            group_first, group_size = np.repeat(first, sizes), np.repeat(sizes, sizes)
            inside = group_first + place
            block = place // width
            sibling = (block ^ 1) * width  # where the block to merge with begins
            low, high = np.zeros(len(place), np.int64), np.clip(group_size - sibling, 0, width)
            left = block % 2 == 0
            active = np.flatnonzero(high > low)
            while len(active):
                middle = (low[active] + high[active]) // 2
                other = at[group_first[active] + sibling[active] + middle]
                # Elements of the left block go before equal ones of the right block.
                before = self.less(other, at[inside[active]], whole[active], ~left[active])
                low[active] = np.where(before, middle + 1, low[active])
                high[active] = np.where(before, high[active], middle)
                active = active[high[active] > low[active]]
            merged = at[inside]
            at[group_first + np.minimum(block, block ^ 1) * width + place % width + low] = merged
            width *= 2
        return at

    def repeated(self, at: np.ndarray, key: np.ndarray, when: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the same ``length`` bytes start at a place of smaller ``when``; equal strings have equal keys."""
        out = np.zeros(len(at), bool)
        order = np.argsort(key, kind="stable")
        ordered, long = key[order], length[order]
        first = np.flatnonzero(np.r_[True, (ordered[1:] != ordered[:-1]) | (long[1:] != long[:-1])]) \
            if len(at) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(at)])
        order = order[np.repeat(sizes > 1, sizes)]
        sizes = sizes[sizes > 1]
        if not len(sizes):
            return out
        first = np.cumsum(sizes) - sizes
        # Sort the places; remember which element each place belongs to.
        element = np.empty(len(self.data), np.int32)
        element[at[order]] = order
        long = length[order]
        places = self.sorted_in_groups(at[order], first, sizes, long[first])
        inner = np.ones(len(places), bool)
        inner[first] = False
        later = np.flatnonzero(inner)
        same = self.hashes(places[later], long[later]) == self.hashes(places[later - 1], long[later])
        later = later[same]
        later = later[self.confirmed(places[later], places[later - 1], long[later])]
        opens = np.ones(len(places), bool)
        opens[later] = False
        first = np.flatnonzero(opens)
        found = element[places]
        earliest = np.repeat(np.minimum.reduceat(when[found], first), np.diff(np.r_[first, len(found)]))
        out[found] = when[found] > earliest
        return out

    def repeated_in_segments(
        self, at: np.ndarray, counts: np.ndarray, anchor: np.ndarray, lead: np.ndarray, when: np.ndarray, length: int,
    ) -> np.ndarray:
        """Whether each string of the segments also starts earlier, segment after segment.

        A segment is ``counts`` strings, from place ``at`` on, whose anchor lies ``lead`` bytes behind ``at``.
        """
        offset = anchor + lead.astype(np.uint64)
        copies = self.repeated(at, mixed(mixed(offset) + counts.astype(np.uint64)), when, counts + length - 1)
        out = np.repeat(copies, counts)
        # Later copies of a segment say nothing that its earliest one does not say.
        _, kind, n = np.unique(anchor[~copies], return_inverse=True, return_counts=True)
        mixed_up = np.zeros(len(at), bool)
        mixed_up[np.flatnonzero(~copies)[n[kind] > 1]] = True
        part = np.flatnonzero(np.repeat(mixed_up, counts))
        counts = counts[mixed_up]
        inside = ranges(counts)
        out[part] = self.repeated(
            np.repeat(at[mixed_up], counts) + inside, mixed(np.repeat(offset[mixed_up], counts) - inside.astype(np.uint64)),
            np.repeat(when[mixed_up], counts) + inside, np.full(len(inside), length))
        return out


def anchors_of(text: Suffixes, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, anchors, hash of each gram): strings of ``length`` bytes inside a document and their anchors.

    ``ends`` are the ends of the documents that lie one after another in ``text``.
    """
    n = len(text.data)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = mixed((text.prefix[GRAM:] - text.prefix[:-GRAM]) * text.inverse[:n - GRAM + 1])
    # Half of the hash and the place in one number: ties go to the left.
    low, span = np.uint64(0xFFFFFFFF), length - GRAM + 1
    place = np.empty(len(grams) - span + 1, np.int64)
    for k in range(0, len(place), _BLOCK):
        least = grams[k:k + _BLOCK + span - 1] & ~low
        least |= np.arange(k, k + len(least), dtype=np.uint64)
        width = 1
        while width < span:  # windows double; the last step overlaps
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place[k:k + _BLOCK] = least & low
    begins = np.r_[0, ends[:-1]]
    counts = np.maximum(ends - begins - length + 1, 0)
    starts = np.repeat(begins, counts) + ranges(counts)
    return starts, place[starts], grams


def settled_lists(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.ListArray, np.ndarray]:
    """Documents, the runs of their places (start, length, ...), and keys that spread them: a settled row meets nothing."""
    both = np.unique((doc << 32) + place)  # rows that repeat an id may name a place twice
    doc, place = both >> 32, both & 0xFFFFFFFF
    opens = np.diff(doc) != 0
    owner = np.flatnonzero(np.r_[np.ones(min(1, len(doc)), bool), opens])
    run = np.flatnonzero(np.r_[np.ones(min(1, len(doc)), bool), opens | (np.diff(place) > 1)])
    pairs = np.stack([place[run], np.diff(np.r_[run, len(doc)])], axis=1).astype(np.int32)
    ends = 2 * np.searchsorted(run, np.r_[owner, len(doc)])
    salt = np.uint64(int(place.sum()) & 0xFFFFFFFF)
    return (doc[owner], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pairs.ravel())),
            mixed(doc[owner].astype(np.uint64) * np.uint64(2654435761) + salt).view(np.int64))


def all_runs(lists: pa.ListScalar) -> np.ndarray:
    """The places of all runs that a document's rows name."""
    if not lists.is_valid or not len(lists.values):
        return np.zeros(0, np.int64)
    return places_of(lists.values.flatten().to_numpy())


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch one after another, and their ends."""
    column = batch.column("text").cast(pa.binary())
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8), ends


def anchor_rows(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Anchors (hp, id, runs) of a batch; those it holds very often are settled as crowded, with a mark."""
    data, ends = _joined(batch)
    text = Suffixes(data)
    _, place, grams = anchors_of(text, ends, length)
    at = np.unique(place)
    h = grams[at] if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(h)])
    doc = np.searchsorted(ends, at, side="right")
    pos = at - np.r_[0, ends][doc]
    again = np.repeat(sizes >= LOCAL_CROWD, sizes)
    mark = first[sizes >= LOCAL_CROWD]
    owners, lists, keys = settled_lists(doc[again], pos[again])
    # In the order of the text: neighbouring rows of a shuffle file then differ little but for the hash.
    alone = np.flatnonzero(~again)
    alone = alone[np.argsort(at[alone])]
    ids = batch.column("id")
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([with_place(h[alone], pos[alone]), with_place(h[mark], np.zeros(len(mark), np.int64)), keys])),
        pa.concat_arrays([ids.take(pa.array(doc[alone])), pa.nulls(len(mark), ids.type), ids.take(pa.array(owners))]),
        pa.concat_arrays([pa.nulls(len(alone) + len(mark), lists.type), lists]),
    ], ["hp", "id", "runs"])


def segment_starts(starts: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which strings begin a segment: neighbours of one document with one anchor."""
    if not len(starts):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, (np.diff(starts) != 1) | (np.diff(place) != 0) | (np.diff(doc) != 0)])


def segment_rows(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Segments (h, id, pos, lead, crowd, bytes) of strings that are first in the batch, and settled runs."""
    data, ends = _joined(batch)
    text = Suffixes(data)
    starts, place, grams = anchors_of(text, ends, length)
    begins = np.r_[0, ends]
    shared, crowd = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    lists, singles, crowded = batch.column("lists"), batch.column("places"), batch.column("crowded")
    for k in range(batch.num_rows):
        crowd[begins[k] + all_runs(lists[k])] = True
        n = int(ends[k] - begins[k])
        shared[begins[k] + all_places(singles[k].as_py(), n)] = True
        # A place is known modulo 65,536 only: of all such places those with the anchor's hash are crowded.
        packed = np.array(crowded[k].as_py(), np.int64).view(np.uint64)
        low = (packed & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        for step in range(0, n, 1 << PLACE_BITS):
            inside = low + step < len(grams) - begins[k]
            at = begins[k] + low[inside] + step
            at, wanted = at[at < ends[k]], packed[inside][at < ends[k]]
            crowd[at[grams[at] >> np.uint64(PLACE_BITS) == wanted >> np.uint64(PLACE_BITS)]] = True
    shared |= crowd
    near = shared[place]
    starts, place = starts[near], place[near]
    h = grams[place] if len(place) else np.zeros(0, np.uint64)
    doc = np.searchsorted(ends, starts, side="right")
    rank = pc.rank(batch.column("id"), tiebreaker="dense").to_numpy().astype(np.int64)
    cut = segment_starts(starts, place, doc)
    again = text.repeated_in_segments(
        starts[cut], np.diff(np.r_[cut, len(starts)]), h[cut], (place - starts)[cut],
        ((rank[doc] << 32) + starts - begins[doc])[cut], length)
    owners, runs, keys = settled_lists(doc[again], (starts - begins[doc])[again])
    starts, place, h, doc = (x[~again] for x in (starts, place, h, doc))
    cut = segment_starts(starts, place, doc)
    last = np.r_[cut[1:], len(starts)] - 1
    segments = [data[a:b + length].tobytes() for a, b in zip(starts[cut].tolist(), starts[last].tolist() if len(cut) else [], strict=True)]
    n = len(owners)
    return pa.RecordBatch.from_arrays([
        # The hash as the anchors were dealt by it.
        pa.array(np.concatenate([(h[cut] >> np.uint64(PLACE_BITS)).view(np.int64), keys])),
        batch.column("id").take(pa.array(np.concatenate([doc[cut], owners]))),
        pa.array(np.concatenate([(starts - begins[doc])[cut], np.zeros(n, np.int64)]).astype(np.int32)),
        pa.array(np.concatenate([(place - starts)[cut], np.zeros(n, np.int64)]).astype(np.int32)),
        pa.array(np.concatenate([crowd[place[cut]], np.ones(n, bool)])),
        pa.array(segments + [None] * n, pa.binary()),
        pa.concat_arrays([pa.nulls(len(cut), runs.type), runs]),
    ], ["h", "id", "pos", "lead", "crowd", "bytes", "runs"])


def group_rows(table: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, id, pos, runs): settled runs, and the single strings of crowded anchors by their hash."""
    settled = table.filter(pc.is_null(table.column("bytes")))
    if settled.num_rows:
        keys = mixed(settled.column("h").to_numpy().astype(np.int64).view(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys), pa.array(keys.astype(np.int32)), settled.column("id").combine_chunks(), pa.array(np.zeros(len(keys), np.int32)),
            settled.column("runs").combine_chunks()], ["a", "b", "id", "pos", "runs"])
    table = table.filter(pc.is_valid(table.column("bytes")))
    if not table.num_rows:
        return
    ids = table.column("id").combine_chunks()
    raw = table.column("bytes").to_pylist()
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    begins = np.cumsum(sizes) - sizes
    text = Suffixes(np.frombuffer(b"".join(raw), np.uint8))
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(raw)), counts)
    inside = ranges(counts)
    starts = begins[owner] + inside
    pos = table.column("pos").to_numpy().astype(np.int64)[owner] + inside
    crowded = table.column("crowd").to_numpy(zero_copy_only=False).astype(bool)
    crowd, calm = crowded[owner], ~crowded
    rank = pc.rank(ids, tiebreaker="dense").to_numpy().astype(np.int64)
    when = (rank << 32) + table.column("pos").to_numpy().astype(np.int64)
    again = np.flatnonzero(~crowd)[text.repeated_in_segments(
        begins[calm], counts[calm], table.column("h").to_numpy().view(np.uint64)[calm],
        table.column("lead").to_numpy().astype(np.int64)[calm], when[calm], length)]
    doc = rank[owner]
    head = np.zeros(int(doc.max()) + 1, np.int64)
    head[doc[::-1]] = owner[::-1]
    owners, runs, keys = settled_lists(doc[again], pos[again])
    hot = np.flatnonzero(crowd)
    one = text.hashes(starts[hot], length)
    two = mixed(text.hashes(starts[hot], GRAM) * np.uint64(3) + text.hashes(starts[hot] + length // 2, length - length // 2))
    n = len(owners)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([mixed(one).view(np.int64), keys])), pa.array(np.concatenate([(two >> np.uint64(32)).astype(np.uint32).view(np.int32), keys.astype(np.int32)])),
        ids.take(pa.array(np.concatenate([owner[hot], head[owners]]))),
        pa.array(np.concatenate([pos[hot], np.zeros(n, np.int64)]).astype(np.int32)),
        pa.concat_arrays([pa.nulls(len(hot), runs.type), runs])], ["a", "b", "id", "pos", "runs"])


def repeated_strings(source: DataFrame, length: int) -> DataFrame:
    """(id, places, lists): starts of strings of ``length`` bytes that also start earlier."""
    kind = source.schema["id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, _BATCH_BYTES):
            yield anchor_rows(batch, length)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, _BATCH_BYTES):
            yield segment_rows(batch, length)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "h"):
            yield from group_rows(table, length)

    found = source.mapInArrow(anchors, f"hp bigint, id {kind}, runs array<int>").repartition(F.expr(HASH))
    same = Window.partitionBy("h")
    mark = F.col("id").isNull() & F.col("runs").isNull()
    shared = found.selectExpr("id", "hp", f"{PLACE} AS pos", "runs", f"{HASH} AS h").select(
        "id", "hp", "pos", "runs", F.count(F.when(F.col("runs").isNull(), 1)).over(same).alias("n"), F.max(mark).over(same).alias("mark")
    ).filter("runs IS NOT NULL OR id IS NOT NULL AND n > 1").withColumn("crowd", F.expr(f"mark OR n > {CROWD}"))
    places = shared.groupBy("id").agg(
        F.collect_list(F.expr("if(runs IS NULL AND NOT crowd, pos, NULL)")).alias("places"),
        F.collect_list(F.expr("if(runs IS NULL AND crowd, hp, NULL)")).alias("crowded"),
        F.collect_list("runs").alias("lists"))
    joined = source.join(places, "id").select("id", "text", "places", "crowded", "lists")
    cut = joined.mapInArrow(segments, f"h bigint, id {kind}, pos int, lead int, crowd boolean, bytes binary, runs array<int>")
    # Groups meet by anchor; strings of crowded anchors go anywhere.
    dealt = cut.repartition(F.expr("if(crowd, xxhash64(id, pos), h)")).sortWithinPartitions("h")
    opened = dealt.mapInArrow(groups, f"a bigint, b int, id {kind}, pos int, runs array<int>")
    least = F.min(F.when(F.col("runs").isNull(), F.struct("id", "pos"))).over(Window.partitionBy("a", "b"))
    return by_document(opened.select("id", "pos", "runs", least.alias("least")).filter(
        "runs IS NOT NULL OR least.id < id OR least.id = id AND least.pos < pos"))


def deduplicated(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary) for each row; with ``digests`` the SHA-256 of ``kept``.

    Removed is each byte under a string of ``length`` bytes that also starts earlier: in a row with a smaller
    id, or earlier in the row. Null and empty texts have no bytes. Rows that repeat an id are one document:
    a string they hold at the same place is not earlier, and what is removed of one at a place is removed of
    all. Rows with a null id neither remove nor lose bytes. Other columns are ignored; an empty table gives
    an empty result. ``length`` is at least 32.
    """
    if length < GRAM:
        raise ValueError(f"strings have at least {GRAM} bytes")
    plain = docs.selectExpr(f"`{id_col}` AS id", f"coalesce(`{text_col}`, '') AS text")
    source = plain.filter("id IS NOT NULL")
    removed = repeated_strings(source, length)
    kind = plain.schema["id"].dataType.simpleString()
    rows = source.join(removed, "id", "left").select("id", "text", "places", "lists").union(
        plain.filter("id IS NULL").selectExpr("id", "text", "cast(NULL AS array<int>)", "cast(NULL AS array<array<int>>)"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in groups_of(batches, 4 * _BATCH_BYTES):
            sizes, gone, spans, kept = [], [], [], []
            texts, lists, singles = batch.column("text"), batch.column("lists"), batch.column("places")
            for k in range(batch.num_rows):
                raw = texts[k].as_py().encode()
                starts = np.concatenate([all_runs(lists[k]), np.array(singles[k].as_py() or [], np.int64)])
                rest, n_gone, n_spans = raw, 0, 0
                if len(starts):
                    edges = np.zeros(len(raw) + length + 1, np.int64)
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + length, -1)
                    covered = np.cumsum(edges)[:len(raw)] > 0
                    rest = np.frombuffer(raw, np.uint8)[~covered].tobytes()
                    n_gone, n_spans = int(covered.sum()), int((np.diff(np.r_[0, covered]) == 1).sum())
                sizes.append(len(raw))
                gone.append(n_gone)
                spans.append(n_spans)
                kept.append(hashlib.sha256(rest).hexdigest() if digests else rest)
            ints = [pa.array(x, pa.int64()) for x in (sizes, gone, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *ints, pa.array(kept, pa.string() if digests else pa.binary())],
                ["id", "n_bytes", "n_removed", "n_spans", name])

    name = "kept_sha256" if digests else "kept"
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, {name} {'string' if digests else 'binary'}"
    return rows.mapInArrow(drop, schema).withColumnRenamed("id", id_col)
