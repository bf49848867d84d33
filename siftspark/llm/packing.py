"""Packing token streams into fixed sequences: cutting stock by column generation.

Each document is cut into pieces of ``capacity`` tokens and a rest. Only lengths are packed: a histogram
of length classes (at most ``capacity / UNIT`` of them, whatever the corpus) goes to the driver. There a
linear program chooses how often each pattern of classes is used. It starts from one pattern per class;
a knapsack by dynamic programming over the dual prices finds the pattern that helps most, until none
does. The patterns are used a whole number of times each, the few pieces left over are packed first-fit
in decreasing order. Then every piece is ranked within its class, in parts that no class can overload,
and its rank names pattern, copy and slot. Rounding lengths up to ``UNIT`` is the only loss inside a
pattern. A sequence is padded to ``capacity`` unless its length is a power of two.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql.window import Window

from siftspark.llm.shared import keyed_text, ranges, written

UNIT = 8
PARTS = 256  # of each length class, for ranking
MAX_COLUMNS = 6_000
BATCH = 40  # columns of a solved knapsack
GAP = 1e-3  # proven distance from the program's optimum at which no more columns are made
# Of a process of tasks: some 80 MB in all.
CACHED_CHUNKS = 400_000
CACHED_PARTS = 100_000

# Fixed value: the pattern of the tokenizer whose texts may be encoded chunk by chunk.
CHUNK_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Chunks of Latin letters only (below U+0250, no white space) are cut here: the same pattern, spelled out.
_LETTERS, _NUMBERS = (
    "".join(re.escape(chr(c)) for c in range(0x21, 0x250) if unicodedata.category(chr(c))[0] == k) for k in "LN")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


def _byte_characters() -> list[str]:
    """The visible character that byte-level models use for each byte: itself, or one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + others.index(b)) for b in range(256)]


_CHARACTERS = _byte_characters()

_encoders: dict[str, "Encoder"] = {}


class _Numbers(dict):
    """Keys numbered as they are met, in one look-up each; ``taken`` gives those new since it was last asked."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def taken(self) -> list:
        new, self.new = self.new, []
        return new


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file.

    Where the file's rules drop white space and never look across it, each distinct chunk between white
    space is encoded by the library once and looked up afterwards. ASCII chunks are first cut by the same
    rules in lower case, since the library treats each such part alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        rules = json.loads(self.tool.to_str())
        steps = [rules["normalizer"], *(rules["normalizer"] or {}).get("normalizers", [])]
        split = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_chunk = (
            split.get("behavior") == "Removed" and split.get("invert") is True
            and split.get("pattern") == {"Regex": CHUNK_PATTERN}
            and {s["type"] for s in steps if s} <= {"Sequence", "NFC", "Replace", "Lowercase"}
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
                        or any(c.isspace() for c in t["content"]) for t in rules["added_tokens"])
        )
        # A chunk that may hold an added token, or characters of other rules, is left to the library whole.
        starts = {t["content"][:2] for t in rules["added_tokens"]}
        markers = {re.escape(x) for x in starts}
        self.special = re.compile("|".join(["[\x00-\x20\x7f-\xa0\u0130\u0250-\U0010ffff]", *sorted(markers)])).search
        self.word_is_part = not any(x.isalpha() for x in starts)
        self._forget_parts()
        self._forget()

    def _forget(self) -> None:
        """Chunks are many and cheap to make again from their parts, which are few."""
        self.known = _Numbers()
        self.flat, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _forget_parts(self) -> None:
        self.parts = _Numbers()
        self.part_flat, self.part_starts = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _by_library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_parts(self) -> None:
        """Ids of the parts that were met for the first time."""
        new = self.parts.taken()
        tokenize = self.tool.model.tokenize
        rows: list[list[int]] = []
        # White space is in no part: such a key is the library's whole chunk.
        whole = [part[1:] for part in new if part[0] == "\n"]
        coded = chain.from_iterable(self._by_library(whole[at:at + 4096]) for at in range(0, len(whole), 4096))
        for part in new:
            if part[0] == "\n":
                rows.append(next(coded))
            else:
                spelled = part if part.isascii() else "".join(map(_CHARACTERS.__getitem__, part.encode()))
                rows.append([t.id for t in tokenize(spelled)])
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        ids = np.fromiter(chain.from_iterable(rows), np.uint32, int(lengths.sum()))
        self.part_flat = np.concatenate([self.part_flat, ids])
        self.part_starts = np.concatenate([self.part_starts, self.part_starts[-1] + np.cumsum(lengths)])

    def _learn(self, new: list[bytes]) -> None:
        plan: list[list[str]] = []
        special, word_is_part = self.special, self.word_is_part
        if len(self.parts) > CACHED_PARTS:
            self._forget_parts()
        for chunk in new:
            if word_is_part and chunk.isalpha():      # ASCII letters alone
                found = [chunk.lower().decode()]
            else:
                text = chunk.decode()
                if not special(text):
                    found = _PARTS.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
                else:
                    found = ["\n" + text]
            plan.append(found)
        counts = np.fromiter(map(len, plan), np.int64, len(plan))
        at = np.fromiter(map(self.parts.__getitem__, chain.from_iterable(plan)), np.int64, int(counts.sum()))
        self._learn_parts()
        lengths = self.part_starts[at + 1] - self.part_starts[at]
        self.flat = np.concatenate([self.flat, self.part_flat[np.repeat(self.part_starts[at], lengths) + ranges(lengths)]])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not self.by_chunk:
            for text in texts:
                yield np.array(self._by_library([text])[0], np.uint32)
            return
        if len(self.known) > CACHED_CHUNKS:
            self._forget()
        split = [t.encode().split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        try:
            at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
            if new := self.known.taken():
                self._learn(new)
        except BaseException:
            self._forget()      # numbers without ids must not outlive the error
            self._forget_parts()
            raise
        for chunks in np.split(at, np.cumsum(counts)[:-1]):
            lengths = self.starts[chunks + 1] - self.starts[chunks]
            yield self.flat[np.repeat(self.starts[chunks], lengths) + ranges(lengths)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --------------------------------------------------------------------------------------- patterns


@dataclass(frozen=True)
class Plan:
    """Patterns of length classes (in units) with the number of sequences of each."""
    patterns: np.ndarray  # pattern x class: pieces of the class in one sequence
    copies: np.ndarray


def knapsack(prices: np.ndarray, units: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest price of pieces for each room, and the class to take next there (-1: leave a unit empty)."""
    worth, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = prices > 1e-12
    sizes, values, names = units[usable], prices[usable], np.flatnonzero(usable)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        worth[room], n = worth[room - 1], fitting[room]
        if n:
            tried = values[:n] + worth[room - sizes[:n]]
            k = int(tried.argmax())
            if tried[k] > worth[room]:
                worth[room], choice[room] = tried[k], names[k]
    return worth, choice


def priced_patterns(prices: np.ndarray, units: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest price of a pattern, and patterns worth more than a sequence: best ones for chosen firsts."""
    worth, choice = knapsack(prices, units, capacity)
    by_first = prices + worth[capacity - units]
    firsts = [k for k in np.argsort(-by_first)[:BATCH].tolist() if by_first[k] > 1 + 1e-9]
    out = {}
    for k in firsts:
        pattern, room = np.zeros(len(units), np.int64), capacity - int(units[k])
        pattern[k] = 1
        while room > 0:
            if choice[room] < 0:
                room -= 1
            else:
                pattern[choice[room]] += 1
                room -= int(units[choice[room]])
        out[pattern.tobytes()] = pattern
    return float(worth[capacity]), np.array(list(out.values()), np.int64).reshape(len(out), len(units))


def first_fit(units: np.ndarray, left: np.ndarray, capacity: int) -> tuple[list[np.ndarray], list[int]]:
    """Patterns, with their uses, that take up ``left``: the largest pieces first, each where it fits."""
    left, chosen, copies = left.copy(), [], []
    while left.any():
        pattern, room = np.zeros(len(units), np.int64), capacity
        for k in range(len(units) - 1, -1, -1):
            take = min(int(left[k]), room // int(units[k]))
            pattern[k], room = take, room - take * int(units[k])
        on = pattern > 0
        times = int((left[on] // pattern[on]).min())
        chosen.append(pattern)
        copies.append(times)
        left -= times * pattern
    return chosen, copies


def solved(units: np.ndarray, counts: np.ndarray, capacity: int, max_columns: int = MAX_COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Basis patterns and (fractional) uses of the relaxed cutting-stock program, by revised simplex.

    First-fit patterns are offered first; then each solution of the knapsack adds a batch of columns.
    """
    patterns = np.diag(capacity // units)
    inverse = np.diag(1.0 / (capacity // units))
    # Slightly uneven demands, so that no pivot is without progress and the simplex cannot cycle.
    uses, bound = inverse @ (counts + np.random.default_rng(1).uniform(0, 1e-2, len(counts))), 0.0
    pool = np.array(first_fit(units, counts.astype(np.int64), capacity)[0], np.int64)
    for _ in range(max_columns):
        prices = inverse.sum(axis=0)
        gains = pool @ prices
        if not len(gains) or gains.max() <= 1 + 1e-7:
            worth, fresh = priced_patterns(prices, units, capacity)
            bound = max(bound, uses.sum() / max(worth, 1.0))  # no plan needs fewer sequences
            if not len(fresh) or uses.sum() <= bound * (1 + GAP):
                break
            pool = np.concatenate([pool[gains > 0.9], fresh])
            gains = pool @ prices
        pattern = pool[int(gains.argmax())]
        change = inverse @ pattern
        rows = np.flatnonzero(change > 1e-9)
        leaves = rows[np.argmin(uses[rows] / change[rows])]
        step = uses[leaves] / change[leaves]
        uses = np.maximum(uses - step * change, 0)
        uses[leaves] = step
        row = inverse[leaves] / change[leaves]
        inverse -= np.outer(change, row)
        inverse[leaves] = row
        patterns[leaves] = pattern
    return patterns, uses


def planned(units: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Whole uses of patterns that take up exactly ``counts`` pieces of each class (``units`` ascending)."""
    units, left = np.asarray(units, np.int64), np.asarray(counts, np.int64).copy()
    chosen, copies = [], []
    if len(units):
        patterns, uses = solved(units, left.astype(float), capacity)
        for k in np.argsort(-uses):
            pattern = patterns[k]
            on = pattern > 0
            times = min(int(uses[k] + 1e-2), int((left[on] // pattern[on]).min()))
            if times > 0:
                chosen.append(pattern)
                copies.append(times)
                left -= times * pattern
    more, times = first_fit(units, left, capacity)  # what rounding down has left
    chosen, copies = chosen + more, copies + times
    return Plan(np.array(chosen, np.int64).reshape(len(chosen), len(units)), np.array(copies, np.int64))


@dataclass(frozen=True)
class Slots:
    """For each class, ranges of ranks and the sequences and slots they fill."""
    base: np.ndarray  # first rank of a range, plus the class times STRIDE
    copies: np.ndarray
    sequence: np.ndarray
    slot: np.ndarray

    STRIDE = 1 << 48

    @classmethod
    def of(cls, plan: Plan, units: np.ndarray) -> "Slots":
        first = np.cumsum(plan.copies) - plan.copies
        rows = []
        for k, unit in enumerate(units.tolist()):
            rank = 0
            for p in np.flatnonzero(plan.patterns[:, k]).tolist():
                slot = int(plan.patterns[p, k + 1:].sum())  # larger pieces stand first
                rows.append((unit * cls.STRIDE + rank, plan.copies[p], first[p], slot))
                rank += int(plan.patterns[p, k] * plan.copies[p])
        return cls(*(np.array(x, np.int64) for x in zip(*rows, strict=True))) if rows else \
            cls(*(np.zeros(0, np.int64) for _ in range(4)))

    def find(self, unit: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = unit * self.STRIDE + rank
        at = np.searchsorted(self.base, key, side="right") - 1
        inside = key - self.base[at]
        return self.sequence[at] + inside % self.copies[at], self.slot[at] + inside // self.copies[at]


# --------------------------------------------------------------------------------------- operator


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, with_ids: bool,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]) of the pieces of every document."""
    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)
        id_type = None
        for batch in batches:
            id_type = batch.column("id").type
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, start, length, crc, total, held = [], [], [], [], [], []
                for k, ids in enumerate(tool.encode(part.column("text").to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(ids), capacity):
                        piece = ids[s:s + capacity]
                        row.append(k)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(ids))
                        if with_ids:
                            held.append(piece.astype(np.int64))
                ints = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                more = [pa.array(held, pa.list_(pa.int64()))] if with_ids else []
                names = ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                columns = [part.column("id").take(pa.array(row, pa.int64())), *ints, *more]
                yield pa.RecordBatch.from_arrays(columns, names[:len(columns)])

    more = ", ids array<bigint>" if with_ids else ""
    return source.mapInArrow(
        run, f"id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint{more}")


def packed(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id",
    text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): every piece and its place.

    A document is the ids of its text and ``end_id``, so null and empty texts have one token. Rows that
    repeat are packed each; null ids stay null; other columns are ignored; an empty table gives an empty
    result. Sequence ids run from 0 without gaps, offsets in a sequence too.
    """
    unit = UNIT if capacity % UNIT == 0 else 1
    cut = written(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids), "pieces")
    cut = cut.withColumn("unit", F.expr(f"cast(ceil(length / {unit}) AS bigint)"))
    cut = cut.withColumn("part", F.expr(f"cast(pmod(xxhash64(id, start, ids_crc32), {PARTS}) AS int)"))
    by_part = cut.groupBy("unit", "part").count()
    found = by_part.groupBy("unit").agg(F.sum("count").alias("n")).orderBy("unit").collect()  # bounded by capacity / unit
    units = np.array([r["unit"] for r in found], np.int64)
    slots = Slots.of(planned(units, np.array([r["n"] for r in found], np.int64), capacity // unit), units)
    before = by_part.select("unit", "part", (F.sum("count").over(
        Window.partitionBy("unit").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    ranked = cut.join(before, ["unit", "part"]).withColumn("rank", F.col("before") - 1 + F.row_number().over(
        Window.partitionBy("unit", "part").orderBy("id", "start", "ids_crc32")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, slot = slots.find(batch.column("unit").to_numpy(), batch.column("rank").to_numpy())
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(slot)], [*names, "sequence_id", "slot"])

    names = [c for c in cut.columns if c not in ("unit", "part")]
    schema = ST.StructType([*(cut.schema[n] for n in names), *(
        ST.StructField(n, ST.LongType()) for n in ("sequence_id", "slot"))])
    placed = ranked.select(*names, "unit", "rank").mapInArrow(place, schema)
    in_sequence = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("offset", F.sum("length").over(in_sequence) - F.col("length"))
    more = ["ids"] if with_ids else []
    return out.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *more)
