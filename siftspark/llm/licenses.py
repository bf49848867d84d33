"""License scans: an exact set-similarity join of text blocks with license notices.

A notice is a set of words; it is found where a block of the text holds at least ``containment`` of them.
Blocks come in layers: for notices of up to L words (L a power of two) they begin at every L-th word and are
2 L words long, so each run of L words lies whole in one block.

1. One pass over the texts notes the places of words that any notice or phrase uses. From these notes, which
   are written once, the number of documents that hold each word is summed: the common order, rare words first.
2. A block that holds ``need`` words of a notice holds one of its ``size - need + 1`` rarest ones (prefix
   filter). Only such blocks become sorted sets. They must be large enough (length filter), and from the first
   word that both share what is left of both must still reach ``need`` (positional filter). Pairs that remain
   are counted in full. No filter loses a pair, so the join is exact.

The notices travel with the tasks' code; their number of words is checked against ``MAX_WORDS``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.shared import keyed_text, ranges, written

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
CONTAINMENT = 0.9
LEAST_BLOCK = 8
MAX_WORDS = 1_000_000
_PIECE = 1 << 20
_ROWS = 1_000

# Phrases that name a license wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices, by the family they belong to. Those of families that differ in one word are kept so short that
# every word counts.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
            " associated documentation files, to deal in the software without restriction, including without"
            " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"
            " copies of the software, and to permit persons to whom the software is furnished to do so"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"
            " is hereby granted, provided that the above copyright notice and this permission notice appear in"
            " all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"
            " provided that the following conditions are met"),
    ("apache", "You may not use this file except in compliance with the license. You may obtain a copy of the"
               " license at www.apache.org/licenses"),
    ("apache", "licensed under the Apache license"),
    ("mpl", "subject to the terms of the Mozilla Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("zlib", "This software is provided as is, without any express or implied warranty. In no event will the"
             " authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "Creative Commons CC0 public domain dedication"),
    ("cc-by", "licensed under a Creative Commons Attribution license"),
    ("cc-by-sa", "licensed under CC BY SA"),
    ("cc-by-sa", "Creative Commons Attribution ShareAlike"),
    ("cc-by-nc", "licensed under CC BY NC"),
    ("cc-by-nc", "Creative Commons Attribution NonCommercial"),
    ("cc-by-nd", "licensed under CC BY ND"),
    ("cc-by-nd", "Creative Commons Attribution NoDerivatives"),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() changes A-Z alone


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of a text, at most about a million bytes at a time."""
    data = text.encode("utf-8", "surrogatepass").lower()
    at = 0
    while at < len(data):
        end = BREAK.search(data, min(at + _PIECE, len(data)))
        stop = end.start() if end else len(data)
        yield WORD.findall(data, at, stop)
        at = max(stop, at + 1)


@dataclass(frozen=True)
class Notice:
    label: str
    words: frozenset[bytes]
    layer: int  # words from one block's start to the next
    need: int  # words that a block has to hold


def notices_of(notices: tuple[tuple[str, str], ...], containment: float) -> list[Notice]:
    if not 0 < containment <= 1:
        raise ValueError("containment is a share above 0")
    out = []
    for label, text in notices:
        words = words_of(text)
        if not words:
            raise ValueError(f"a notice of {label} has no words")
        layer = max(LEAST_BLOCK, 1 << (len(words) - 1).bit_length())
        distinct = frozenset(words)
        # A share of 0.9 of ten words is nine, whatever its binary fraction says.
        out.append(Notice(label, distinct, layer, math.ceil(round(containment * len(distinct), 9))))
    if sum(len(n.words) for n in out) > MAX_WORDS:
        raise ValueError(f"notices of more than {MAX_WORDS} words don't fit into every task")
    return out


def noted(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, pos, tok): where the words of the vocabulary stand in each text."""
    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    known = {w: k for k, w in enumerate(vocabulary)}

    def places(text: str) -> tuple[int, np.ndarray, np.ndarray]:
        n, pos, tok = 0, [], []
        for words in pieces(text):
            found = np.fromiter((known.get(w, -1) for w in words), np.int32, len(words))
            hit = np.flatnonzero(found >= 0)
            pos.append(hit + n)
            tok.append(found[hit])
            n += len(words)
        empty = [np.zeros(0, np.int32)]
        return n, np.concatenate(pos or empty).astype(np.int32), np.concatenate(tok or empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                rows = [places(t.as_py()) for t in part.column("text")]
                ends = np.cumsum([0, *(len(p) for _, p, _ in rows)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, np.concatenate([r[k] for r in rows])) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([n for n, _, _ in rows], pa.int64()), *lists], ["id", "n_words", "pos", "tok"])

    return source.mapInArrow(run, f"id {kind}, n_words bigint, pos array<int>, tok array<int>")


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and word of each note of a batch."""
    pos, tok = batch.column("pos"), batch.column("tok")
    lengths = pos.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(batch.num_rows), lengths), pos.flatten().to_numpy(), tok.flatten().to_numpy()


def ranks(notes: DataFrame, size: int) -> np.ndarray:
    """For each word its place in the order by the number of documents that hold it, rare ones first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            row, _, tok = flat(batch)
            counts += np.bincount(np.unique(row * size + tok) % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(counts)], ["tok", "docs"])

    total = np.zeros(size, np.int64)
    sums = notes.select("pos", "tok").mapInArrow(run, "tok bigint, docs bigint").groupBy("tok").agg(F.sum("docs").alias("docs"))
    for row in sums.collect():  # one for each word of the notices
        total[row["tok"]] = row["docs"]
    out = np.empty(size, np.int64)
    out[np.lexsort((np.arange(size), total))] = np.arange(size)
    return out


@dataclass(frozen=True)
class Layer:
    """The notices of one block length as sorted sets, and the index of their prefixes."""

    step: int
    members: np.ndarray  # notice by rank of a word: whether it has it
    sizes: np.ndarray
    needs: np.ndarray
    labels: list[str]
    used: np.ndarray  # by rank: whether any notice has the word
    prefix: np.ndarray  # by rank: whether it is among the rarest of a notice
    posting: tuple[np.ndarray, np.ndarray, np.ndarray]  # rank, notice, place in the notice: of each word of a prefix


def layers_of(notices: list[Notice], known: dict[bytes, int], rank: np.ndarray) -> list[Layer]:
    out = []
    for step in sorted({n.layer for n in notices}):
        own = [n for n in notices if n.layer == step]
        members = np.zeros((len(own), len(rank)), bool)
        posting, prefix = [], np.zeros(len(rank), bool)
        for t, notice in enumerate(own):
            order = np.sort(rank[[known[w] for w in notice.words]])
            members[t, order] = True
            rarest = order[:len(order) - notice.need + 1]
            prefix[rarest] = True
            posting += [(r, t, j) for j, r in enumerate(rarest)]
        posting = np.array(sorted(posting), np.int64).T
        out.append(Layer(step, members, members.sum(axis=1), np.array([n.need for n in own]), [n.label for n in own],
                         members.any(axis=0), prefix, tuple(posting)))
    return out


def joined(row: np.ndarray, pos: np.ndarray, rank: np.ndarray, layer: Layer) -> tuple[np.ndarray, ...]:
    """Row, block, notice and shared words of all pairs that meet the threshold; ``rank`` is that of each note."""
    own = layer.used[rank]
    row, block, rank = row[own], (pos[own] // layer.step).astype(np.int64), rank[own]
    # A word lies in the block that begins last before it, and in the one before that.
    again = block > 0
    key = np.concatenate([(row << 32) | block, ((row << 32) | block - 1)[again]])
    rank = np.concatenate([rank, rank[again]])
    # Blocks with a word of a prefix; the others can't reach any notice.
    chosen = np.unique(key[layer.prefix[rank]])
    if not len(chosen):
        return (np.zeros(0, np.int64),) * 4
    at = np.minimum(np.searchsorted(chosen, key), len(chosen) - 1)
    inside = chosen[at] == key
    pair = np.unique(at[inside] * len(layer.prefix) + rank[inside])
    block, rank = pair // len(layer.prefix), pair % len(layer.prefix)  # sorted sets, one after another
    size = np.bincount(block, minlength=len(chosen))
    place = ranges(size)
    # Each word of a block's set meets the notices that have it in their prefix.
    ranked, notice, other = layer.posting
    first, last = np.searchsorted(ranked, rank), np.searchsorted(ranked, rank, side="right")
    times = last - first
    meet = np.repeat(first, times) + ranges(times)
    b, i, t, j = np.repeat(block, times), np.repeat(place, times), notice[meet], other[meet]
    need = layer.needs[t]
    left = 1 + np.minimum(size[b] - 1 - i, layer.sizes[t] - 1 - j)
    good = (size[b] >= need) & (left >= need)
    open_ = np.unique(t[good] * len(chosen) + b[good])
    t, b = open_ // len(chosen), open_ % len(chosen)
    shared = np.zeros(len(t), np.int64)
    for k in np.unique(t):  # verification: whole sets
        shared[t == k] = np.bincount(block, weights=layer.members[k, rank], minlength=len(chosen))[b[t == k]]
    met = shared >= layer.needs[t]
    t, b = t[met], b[met]
    return chosen[b] >> 32, chosen[b] & 0xFFFFFFFF, t, shared[met]


def phrase_places(row: np.ndarray, pos: np.ndarray, tok: np.ndarray, phrase: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the first word wherever the words of a phrase stand consecutively."""
    n = len(tok) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    fits = np.ones(n, bool)
    for k, word in enumerate(phrase):
        fits &= (tok[k:k + n] == word) & (row[k:k + n] == row[:n]) & (pos[k:k + n] == pos[:n] + k)
    return row[:n][fits], pos[:n][fits]


BLOCKS = "array<struct<label:string,start:int,stop:int,share:double>>"


def scanned(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
    notices: tuple[tuple[str, str], ...] = NOTICES, containment: float = CONTAINMENT,
) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for each row.

    Words are runs of digits, letters a-z and everything outside ASCII, A-Z lower-cased, of the whole text.
    ``n_base`` counts all places of all phrases; ``blocks`` has the blocks that hold at least ``containment``
    of a notice's distinct words, as label, first word, word behind the last one, and share. ``score`` is 1
    where a phrase stands, else the largest share, else 0. Null and empty texts have no words, no labels (an
    empty string) and score 0. Rows that repeat come out as often as they come in, null ids stay null, other
    columns are ignored, and an empty table gives an empty result.
    """
    phrases = PHRASES if phrases is None else phrases
    found = notices_of(notices, containment)
    named = [([*words_of(text)], label) for text, label in phrases.items()]
    vocabulary = sorted({w for n in found for w in n.words} | {w for words, _ in named for w in words})
    known = {w: k for k, w in enumerate(vocabulary)}
    notes = written(noted(docs, vocabulary, id_col, text_col), "license_words")
    rank = ranks(notes, max(1, len(vocabulary)))
    layers = layers_of(found, known, rank)
    sought = [([known[w] for w in words], label) for words, label in named if words]
    kind = notes.schema["id"].dataType.simpleString()

    def of_part(part: pa.RecordBatch) -> pa.RecordBatch:
        row, pos, tok = flat(part)
        n = part.num_rows
        count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set[str]] = [set() for _ in range(n)]
        for phrase, label in sought:
            r, p = phrase_places(row, pos, tok, phrase)
            count += np.bincount(r, minlength=n)
            np.minimum.at(first, r, p)
            np.maximum.at(last, r, p)
            for k in np.unique(r):
                base[k].add(label)
        words = part.column("n_words").to_numpy()
        blocks: list[list[dict]] = [[] for _ in range(n)]
        for layer in layers:
            for r, b, t, shared in zip(*joined(row, pos, rank[tok], layer), strict=True):
                start = int(b) * layer.step
                blocks[r].append({"label": layer.labels[t], "start": start, "share": float(shared / layer.sizes[t]),
                                  "stop": int(min(start + 2 * layer.step, words[r]))})
        for b in blocks:
            b.sort(key=lambda x: (x["start"], x["stop"], x["label"]))
        none = count == 0
        return pa.RecordBatch.from_arrays([
            part.column("id"), part.column("n_words"), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
            pa.array([",".join(sorted(x)) for x in base], pa.string()),
            pa.array([",".join(sorted(x | {y["label"] for y in b})) for x, b in zip(base, blocks, strict=True)], pa.string()),
            pa.array([1.0 if c else max((y["share"] for y in b), default=0.0) for c, b in zip(count, blocks, strict=True)]),
            pa.array(blocks, pa.list_(pa.struct([
                ("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("share", pa.float64())]))),
        ], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield of_part(batch.slice(at, _ROWS))

    return notes.mapInArrow(
        run, f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
             f" labels string, score double, blocks {BLOCKS}").withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scanned`` with the built-in phrases and notices, without the blocks."""
    return scanned(docs, id_col, text_col).drop("blocks")
