"""SimHash near-duplicates: a byte-position index with count filtering.

Two fingerprints of 64 bits that differ in at most ``d`` bits agree in at least ``8 - d`` of their eight
bytes. A list of all fingerprints with one value of one byte would be far too long at scale, so the index
joins positions: its keys are the ``7 - d`` bytes at each choice of ``7 - d`` positions (five for d = 2). For
each pair of a list the shared positional bytes are tallied; pairs that share no more than the key, fewer than
the guaranteed ``8 - d``, are dropped, and the bits of the others are verified.
A list of more than ``LONG`` fingerprints is split: a pair of it that counts shares one position more, so the
fingerprints go on under the joined keys of one position more. Such a list holds at most ``256 ** d`` of them
(65,536 for d = 2), whatever the input, and its tallies are made in strips.
Equal fingerprints are one node throughout. Links leave a list as a forest, which joins the same nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from siftspark.llm.components import components
from siftspark.llm.shared import keyed_text, ranges, written

SEED = 42
_BLOCK = 20_000  # shingles whose bits are unpacked at once
_ROWS = 500  # of which texts are unpacked at once
LONG = 4_096  # fingerprints of a list that is split
SHORT = 48  # lists up to this length are tallied side by side, longer ones each in strips
_STRIP = 500_000  # pairs of a strip


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[k:] for k in range(size)), strict=False)]


def fingerprint(words: list[bytes], size: int) -> int:
    """64 bits: each set if it is set in over half of the hashes of all shingles, repeats included."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in _shingles(words, size)], dtype="<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at:at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(rows: DataFrame, shingle: int, text: Callable[[pa.RecordBatch], pa.Array], kept: list[str]) -> DataFrame:
    """The columns ``kept`` of ``rows`` and fp bigint; ``text`` finds the texts in a batch, null ones are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                # bytes.lower() changes A-Z alone
                found = [fingerprint((t or "").encode("utf-8", "surrogatepass").lower().split(), shingle) for t in text(batch).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(np.array(found, np.uint64).view(np.int64))], [*kept, "fp"])

    return rows.mapInArrow(run, ST.StructType([*(rows.schema[c] for c in kept), ST.StructField("fp", ST.LongType())]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint): ASCII letters lower-cased, words between ASCII white space; null text has none."""
    return with_fingerprints(keyed_text(docs, id_col, text_col), shingle, lambda batch: batch.column("text"), ["id"])


def masks(positions: int) -> np.ndarray:
    """For each choice of so many byte positions, the mask that keeps them."""
    return np.array([sum(0xFF << (8 * p) for p in kept) for kept in combinations(range(8), positions)], np.uint64)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At how many of the eight positions both have the same byte."""
    return ((a ^ b).astype("<u8").view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _side_by_side(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of short lists, which lie one after another: first each with the next, and so on."""
    for step in range(1, len(group)):
        low = np.flatnonzero(group[step:] == group[:-step])
        if not len(low):
            return
        yield low, low + step


def retained(fps: np.ndarray, low: np.ndarray, high: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Count filtering, then verification: pairs with enough shared bytes, of these the ones near each other."""
    enough = shared_bytes(fps[low], fps[high]) >= 8 - distance
    low, high = low[enough], high[enough]
    near = np.bitwise_count(fps[low] ^ fps[high]) <= distance
    return low[near], high[near]


def _in_strips(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``retained`` for all pairs of one long list, strip by strip."""
    columns = np.ascontiguousarray(fps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    varied = [c for c in columns if (c != c[0]).any()]  # all pairs share the other positions
    width = max(1, _STRIP // len(fps))
    for at in range(0, len(fps), width):
        tally = np.full((min(width, len(fps) - at), len(fps) - at), 8 - len(varied), np.uint8)
        for c in varied:
            tally += c[at:at + width, None] == c[None, at:]
        low, high = np.nonzero(tally >= 8 - distance)
        low, high = low + at, high + at
        near = (high > low) & (np.bitwise_count(fps[low] ^ fps[high]) <= distance)
        yield low[near], high[near]


def links_in_lists(fps: np.ndarray, lengths: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that link all fingerprints of each list which are near each other (a spanning forest).

    ``fps`` holds the lists one after another, without repeats inside a list.
    """
    starts = np.cumsum(lengths) - lengths
    short = lengths <= SHORT
    place = np.flatnonzero(np.repeat(short, lengths))
    group = np.repeat(np.arange(len(lengths)), lengths)[place]
    found = [retained(fps, place[a], place[b], distance) for a, b in _side_by_side(group)]
    for at, n in zip(starts[~short], lengths[~short], strict=True):
        found += [(a + at, b + at) for a, b in _in_strips(fps[at:at + n], distance)]
    low, high = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
    label = np.arange(len(fps))
    while len(low):  # labels sink to the smallest of each component
        new = label.copy()
        np.minimum.at(new, high, label[low])
        np.minimum.at(new, low, label[high])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(label)))
    return fps[label[moved]], fps[moved]


def _postings(values: DataFrame, positions: int) -> DataFrame:
    """(choice, bytes, fp): each fingerprint under the joined bytes of every choice of positions."""
    keys = F.array(*(F.struct(F.lit(k).cast("int").alias("choice"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("bytes"))
                     for k, m in enumerate(masks(positions))))
    return values.select("fp", F.explode(keys).alias("key")).select("key.choice", "key.bytes", "fp")


def _meet(postings: DataFrame, distance: int, split: bool) -> DataFrame:
    """(a, b, choice): links of each list, choice null; with ``split``, the longest lists' fingerprints under
    their keys of one position more instead, as fp, bytes and choice."""
    kept, finer = masks(7 - distance), masks(8 - distance)

    def links(fps: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        a, b = links_in_lists(fps, lengths, distance)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int32())], ["a", "b", "choice"])

    def refined(choice: int, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.flatnonzero((finer & kept[choice]) == kept[choice]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps.view(np.int64)), pa.array((fps & finer[k]).view(np.int64)), pa.array(np.full(len(fps), k, np.int32))],
                ["a", "b", "choice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        passing = None  # the key of a list that is too long, while it lasts

        def settle(choice: np.ndarray, key: np.ndarray, fps: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, passing
            edge = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])]) if len(key) else np.zeros(0, np.int64)
            lengths = np.diff(np.r_[edge, len(key)])
            long = lengths > LONG if split else np.zeros(len(edge), bool)
            if len(edge) and (choice[0], key[0]) == passing:
                long[0] = True
            for at, n in zip(edge[long], lengths[long], strict=True):
                yield from refined(int(choice[at]), fps[at:at + n])
            stays = not last and len(edge) and not long[-1]  # the last list may go on
            passing = (choice[-1], key[-1]) if len(edge) and long[-1] else None
            whole = ~long & (lengths > 1)
            if stays:
                whole[-1] = False
            yield links(fps[np.repeat(whole, lengths)], lengths[whole])
            begun = edge[-1] if stays else len(key)
            held = (choice[begun:], key[begun:], fps[begun:])

        for batch in batches:
            new = (batch.column("choice").to_numpy(), batch.column("bytes").to_numpy(), batch.column("fp").to_numpy().view(np.uint64))
            yield from settle(*(np.concatenate(x) for x in zip(held, new, strict=True)), False)
        yield from settle(*held, True)

    spread = postings.repartition("choice", "bytes").sortWithinPartitions("choice", "bytes")
    return spread.mapInArrow(run, "a bigint, b bigint, choice int")


def linked(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) of distinct values of ``fp``: a set of links that connects whatever is near each other."""
    # Every fingerprint becomes dozens of rows: a written table of them would be read by few tasks.
    values = prints.select("fp").distinct().repartition("fp")
    first = written(_meet(_postings(values, 7 - distance), distance, split=True), "links")
    again = first.filter("choice IS NOT NULL").selectExpr("choice", "b AS bytes", "a AS fp").distinct()
    finer = _meet(again, distance, split=False)
    return first.filter("choice IS NULL").select("a", "b").unionByName(finer.select("a", "b"))


def _components(owners: DataFrame, distance: int) -> DataFrame:
    """(fp, own, component_id) of (fp, own): the smallest id of each fingerprint and that of its component."""
    found = components(linked(owners, distance))
    best = found.join(owners, found["node"] == owners["fp"]).groupBy("component").agg(F.min("own").alias("best"))
    return (
        owners.join(found, owners["fp"] == found["node"], "left").join(best, "component", "left")
        .select("fp", "own", F.coalesce("best", "own").alias("component_id"))
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2,
) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row.

    Fingerprints that differ in at most ``distance`` bits link; ``component_id`` is the smallest id that
    links lead to. Null, empty and blank texts have the fingerprint 0 and link like any other. Rows with a
    null id get a fingerprint and no component. Rows that repeat come out as often as they come in; other
    columns are ignored; an empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    owners = prints.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("own"))
    of_fp = _components(written(owners, "owners"), distance)
    return prints.join(of_fp, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2,
) -> DataFrame:
    """One row, with all columns, of each group that ``near_duplicates`` finds: the one with the smallest id.

    Null, empty and blank texts have the fingerprint 0 and are grouped like any other. Of rows that repeat an id
    and a fingerprint the one with the least text stays. Rows with a null id belong to no group and stay. Other
    columns come along; an empty table gives an empty result.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    place = docs.columns.index(text_col)
    rows = written(with_fingerprints(
        docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id")), shingle,
        lambda batch: pc.struct_field(batch.column("row"), [place]), ["row", "id"]), "rows")
    known = rows.filter("id IS NOT NULL")
    owners = written(known.groupBy("fp").agg(F.min("id").alias("own")), "owners")
    kept = _components(owners, distance).filter("own = component_id").groupBy(F.col("own").alias("id")).agg(F.min("fp").alias("fp"))
    body = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    single = known.join(kept, ["id", "fp"], "left_semi").groupBy("id", "fp").agg(F.min_by("row", body).alias("row"))
    return single.select("row.*").union(rows.filter("id IS NULL").select("row.*"))
