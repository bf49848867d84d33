"""Token counts of whole texts, huge ones by chunks that overlap.

A text longer than ``chunk_chars`` is encoded in chunks. Neighbouring chunks share ``overlap_chars``;
inside the shared part they are spliced at a boundary at which both encodings are proven to agree. The
proof comes from the vocabulary: if no piece continues from a character that is not a space into a
space, no merge can cross the place before such a space, so what stands left and right of it is encoded
alike in any surroundings. Both encodings must still show a token boundary there and the same tokens
between it and the end of the shared part (less the part where the cut itself may reach); if there is no
such place, or they disagree, the overlap is doubled, at last up to the whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from siftspark.llm.shared import keyed_text

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
Encoded = tuple[list[int], list[tuple[int, int]]]

_loaded: dict[str, "Library"] = {}


class Library:
    """One interface over both libraries: plain counts of short texts, ids with offsets of chunks."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            tool = sentencepiece.SentencePieceProcessor(model_file=path)
            self.counts = lambda texts: [len(x) for x in tool.encode(texts, num_threads=1)]

            def offsets(text: str) -> Encoded:
                out = tool.encode_as_offset_mapping(text)
                return out["ids"], out["offsets"]

            pieces = (tool.id_to_piece(i) for i in range(tool.get_piece_size()))
            self.splits_at_spaces = not any("▁" in p.lstrip("▁") for p in pieces)
            self.spaces = " ▁"
        else:
            from tokenizers import Tokenizer

            tool = Tokenizer.from_file(path)
            tool.no_truncation()
            tool.no_padding()
            self.counts = lambda texts: [
                len(x.ids) for x in tool.encode_batch(texts, add_special_tokens=False)]

            def offsets(text: str) -> Encoded:
                out = tool.encode(text, add_special_tokens=False)
                return out.ids, out.offsets

            # Pre-tokens of the known patterns start at a single space between two other characters.
            self.splits_at_spaces = tool.pre_tokenizer is not None
            self.spaces = " "
        self.offsets: Callable[[str], Encoded] = offsets


def library(path: str) -> Library:
    if path not in _loaded:
        _loaded[path] = Library(path)
    return _loaded[path]


def stable_places(text: str, start: int, end: int, spaces: str) -> Iterator[int]:
    """Places in (start, end) right before a single space with other characters on both sides."""
    at = start
    while True:
        at = min((p for p in (text.find(s, at + 1, end) for s in spaces) if p >= 0), default=-1)
        if at < 0:
            return
        if not text[at - 1].isspace() and text[at - 1] not in spaces \
                and at + 1 < len(text) and not text[at + 1].isspace() and text[at + 1] not in spaces:
            yield at


def _inside(encoded: Encoded, origin: int, start: int, end: int) -> list[tuple[int, int]]:
    """(place, id) of the tokens that begin in [start, end), places as in the whole text."""
    return [(b + origin, i) for i, (b, _) in zip(*encoded, strict=True) if start <= b + origin < end]


def _cuts(encoded: Encoded, origin: int, at: int) -> bool:
    """No token reaches over ``at``."""
    return not any(b + origin < at < e + origin for b, e in encoded[1])


def spliced_ids(text: str, lib: Library, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of a whole text from chunks of about ``chunk`` characters; equal to one encoding of it."""
    if len(text) <= chunk or not lib.splits_at_spaces:
        return lib.offsets(text)[0]
    ids: list[int] = []
    origin, start = 0, 0  # where the current chunk begins, and the first place of it not yet counted
    end = min(chunk, len(text))
    current = lib.offsets(text[:end])
    while end < len(text):
        shared = overlap
        while True:
            # The next chunk reaches from inside the current one over the next ``chunk`` characters.
            left = max(start, end - shared)
            stop = min(len(text), max(end + chunk - overlap, left + 1))
            following, at = None, None
            for place in stable_places(text, left, end, lib.spaces):
                if place <= start:
                    continue
                following = following or lib.offsets(text[left:stop])
                last = next(reversed(list(stable_places(text, place, end, lib.spaces))), place)
                if _cuts(current, origin, place) and _cuts(following, left, place) and \
                        _inside(current, origin, place, last) == _inside(following, left, place, last):
                    at = place
                    break
            if at is not None:
                ids += [i for _, i in _inside(current, origin, start, at)]
                origin, start, end, current = left, at, stop, following
                break
            if left <= start:  # nowhere to splice in all that is left of this chunk: read on
                end = min(len(text), end + max(chunk, end - start))
                current = lib.offsets(text[origin:end])
                if end == len(text):
                    break
                continue
            shared *= 2
    return ids + [i for _, i in _inside(current, origin, start, len(text) + 1)]


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id", text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for each row.

    ``tokenizer`` is the path of a ``.model`` (sentencepiece) or ``.json`` (tokenizers) file that every
    executor can open. Null and empty texts have 0 tokens. Rows that repeat are counted each; null ids
    stay null; other columns are ignored. An empty table gives an empty result.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(tokenizer)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [0] * len(texts)
            short = [k for k, t in enumerate(texts) if t and len(t) <= chunk_chars]
            for at in range(0, len(short), 256):
                part = short[at:at + 256]
                for k, c in zip(part, lib.counts([texts[k] for k in part]), strict=True):
                    n[k] = c
            for k, t in enumerate(texts):
                if len(t) > chunk_chars:
                    n[k] = len(spliced_ids(t, lib, chunk_chars, overlap_chars))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                ["id", "n_bytes", "n_tokens"])

    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    counted = source.selectExpr("id", "text", "cast(octet_length(text) AS bigint) AS n_bytes").mapInArrow(
        count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.selectExpr(f"id AS `{id_col}`", "n_bytes", "n_tokens", f"n_tokens > {int(limit)} AS over_limit")
