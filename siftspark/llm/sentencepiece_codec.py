"""Encoding and decoding with a SentencePiece BPE model, by merge rounds over flat numpy arrays.

A text is cut into words: a run of spaces with the characters behind it. No piece of the vocabulary
holds a space behind another character (checked when a model is loaded), so no merge leaves a word and
each distinct word is encoded once. The words not met before lie one after another in one symbol array.
A round looks up the pieces of all neighbours, takes the best rank of each word, merges all neighbours
of that rank from the left at once, and compacts the array; words without a merge leave. Where the
merged piece could combine with its neighbour into a piece of better rank, only the leftmost place is
merged in that round, since the next merge may then come first.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftspark.llm.shared import keyed_text, ranges

SPACE = "▁"
CACHED_WORDS = 600_000
NONE = np.int64(1 << 40)

_codecs: dict[str, "Codec"] = {}


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as messages

        model = messages.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces:
            raise ValueError("only BPE models without normalisation rules are encoded here")
        kinds = [p.type for p in model.pieces]
        if any(k == 4 for k in kinds):
            raise ValueError("models with user-defined pieces are not supported")
        tool = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unknown = tool.bos_id(), tool.eos_id(), tool.unk_id()
        self.prefix = normal.add_dummy_prefix
        self.unk_surface = model.trainer_spec.unk_surface
        byte_ids = [i for i, k in enumerate(kinds) if k == 6]
        self.byte_of = {i: int(model.pieces[i].piece[3:5], 16) for i in byte_ids}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        self.control = {i for i, k in enumerate(kinds) if k == 3}
        self.vocabulary = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.vocabulary):
            raise ValueError("pieces with inner spaces are not supported")
        self.surface = [
            b"" if k == 3 else bytes([self.byte_of[i]]) if k == 6
            else (self.unk_surface if k == 2 else p.piece.replace(SPACE, " ")).encode()
            for i, (k, p) in enumerate(zip(kinds, model.pieces, strict=True))]
        self.surface_sizes = np.array([len(x) for x in self.surface], np.int64)
        self.surface_starts = np.cumsum(self.surface_sizes) - self.surface_sizes
        self.surface_bytes = np.frombuffer(b"".join(self.surface), np.uint8)
        self.leads_with_space = np.array(
            [k == 1 and p.piece.startswith(SPACE) for k, p in zip(kinds, model.pieces, strict=True)])
        # Rank: 0 is the piece with the best score.
        ids = np.array(sorted(self.vocabulary.values()))
        order = ids[np.argsort([-model.pieces[i].score for i in ids], kind="stable")]
        rank = np.full(len(kinds), NONE)
        rank[order] = np.arange(len(order))
        self.by_rank = order
        self.size = len(kinds) + 1  # the last symbol stands for characters outside the vocabulary
        self.other = len(kinds)
        pairs, early = [], np.zeros(len(order), dtype=bool)
        for piece, i in self.vocabulary.items():
            for cut in range(1, len(piece)):
                left, right = self.vocabulary.get(piece[:cut]), self.vocabulary.get(piece[cut:])
                if left is not None and right is not None:
                    pairs.append((left * self.size + right, rank[i]))
                    for part, text in ((left, piece[:cut]), (right, piece[cut:])):
                        if len(text) > 1 and rank[i] <= rank[part]:
                            early[rank[part]] = True
        pairs.sort()
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [NONE], dtype=np.int64)
        self.early = early  # by rank: a neighbour may join such a piece before its like elsewhere is made
        self.symbol_of = np.full(0x110000, self.other, np.int64)
        for char, i in self.vocabulary.items():
            if len(char) == 1:
                self.symbol_of[ord(char)] = i
        self._forget()

    # ------------------------------------------------------------------------------ encoding

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        """The words of a text, each without its first space."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        text = text if self.prefix else text.removeprefix(" ")
        out = text.split(" ")
        if "" in out:
            out = [w[1:] for w in re.findall(r" +[^ ]*", " " + text)]
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge_rounds(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges and, for each, the word it belongs to (both sorted by word)."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            pair[:-1] = np.where(word[:-1] == word[1:], self._pair_ranks(symbols[:-1], symbols[1:]), NONE)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(pair, first)
            sizes = np.diff(np.r_[first, len(word)])
            open_ = np.repeat(best < NONE, sizes)
            if not open_.all():
                done.append((symbols[~open_], word[~open_]))
                symbols, word, pair = symbols[open_], word[open_], pair[open_]
                best, sizes = best[best < NONE], sizes[best < NONE]
                if not len(symbols):
                    break
            best = np.repeat(best, sizes)
            hit = np.flatnonzero(pair == best)
            # Of touching places every other one, from the left; of "early" pieces the leftmost alone.
            run = np.cumsum(np.r_[0, np.diff(hit) != 1])
            run_start = np.r_[0, np.flatnonzero(np.diff(run)) + 1]
            hit = hit[(np.arange(len(hit)) - run_start[run]) % 2 == 0]
            leftmost = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            hit = hit[leftmost | ~self.early[best[hit]]]
            symbols[hit] = self.by_rank[best[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # where the merged symbols stand after compaction
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            touched = np.zeros(len(symbols), dtype=bool)
            touched[moved] = True
            touched[moved[moved > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            inner = fresh[(fresh + 1 < len(symbols))]
            pair[fresh] = NONE
            inner = inner[word[inner] == word[inner + 1]]
            pair[inner] = self._pair_ranks(symbols[inner], symbols[inner + 1])
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        spelled = [SPACE + w.replace(" ", SPACE) for w in words]
        if not self.prefix:
            raise ValueError("models without a leading space are not supported")
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        text = "".join(spelled)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        # Characters outside the vocabulary never merge: their places keep the symbol and become bytes.
        single = self.symbol_of[points]
        symbols, word = self.merge_rounds(single.copy(), lengths)
        strange = symbols == self.other
        if not strange.any():
            return symbols.astype(np.int32), np.bincount(word, minlength=len(words))
        # They come in the order of the text, for symbols stay in order and these are never merged.
        chars = points[single == self.other]
        spelled_bytes = [[self.id_of_byte.get(b, self.unknown) for b in chr(c).encode()] if self.id_of_byte
                         else [self.unknown] for c in chars.tolist()]
        counts = np.ones(len(symbols), np.int64)
        counts[strange] = [len(x) for x in spelled_bytes]
        out = np.repeat(symbols, counts)
        out[np.repeat(strange, counts)] = [i for x in spelled_bytes for i in x]
        return out.astype(np.int32), np.bincount(np.repeat(word, counts), minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, without begin and end, and the number of each."""
        split = [self.words(t) for t in texts]
        if len(self.known) > CACHED_WORDS:
            self._forget()
        known = self.known
        new = list(dict.fromkeys(itertools.filterfalse(known.__contains__, itertools.chain.from_iterable(split))))
        if new:
            ids, lengths = self._encode_words(new)
            base = len(self.starts) - 1
            known.update(zip(new, range(base, base + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        every = itertools.chain.from_iterable(split)
        at = np.fromiter(map(known.__getitem__, every), np.int64, int(n_words.sum()))
        lengths = self.starts[at + 1] - self.starts[at]
        ids = self.flat[np.repeat(self.starts[at], lengths) + ranges(lengths)]
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(n_words)] if len(split) else np.zeros(0, np.int64)
        return ids, np.diff(np.r_[0, ends]).astype(np.int64)

    # ------------------------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids. Byte pieces form UTF-8; each byte that is none becomes U+FFFD."""
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of rows of ids that lie one after another."""
        sizes = self.surface_sizes[ids]
        spelled = self.surface_bytes[np.repeat(self.surface_starts[ids], sizes) + ranges(sizes)].tobytes()
        ends = np.cumsum(lengths)
        byte_ends = np.r_[0, np.cumsum(sizes)][ends]
        out, start = [], 0
        for end, n, at in zip(ends.tolist(), lengths.tolist(), byte_ends.tolist()):
            raw, start = spelled[start:at], at
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = self._decode_runs(ids[end - n:end])
            lead = end - n  # the first piece that is no control piece loses its space
            while lead < end and int(ids[lead]) in self.control:
                lead += 1
            if self.prefix and lead < end and text[:1] == " " and self.leads_with_space[ids[lead]]:
                text = text[1:]
            out.append(text)
        return out

    def _decode_runs(self, ids: np.ndarray) -> str:
        """Run by run: pieces of the vocabulary are whole characters, runs of byte pieces may be none."""
        out, raw = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            out += [_utf8(bytes(raw)), self.surface[i].decode()]
            raw.clear()
        return "".join([*out, _utf8(bytes(raw))])


def _utf8(raw: bytes) -> str:
    """Valid characters as they are, every other byte as U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _groups(texts: list[str], chars: int = 4_000_000) -> Iterator[slice]:
    """Slices of rows with about so many characters, so that arrays stay small."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > chars:
            yield slice(start, k)
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def coded(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False,
) -> DataFrame:
    """(id_col, ids array<int> with begin and end, decoded string) for each row.

    With ``digests`` (id_col, n_tokens, ids_sha256, decoded_sha256) instead, so that no ids leave the
    task. Null and empty texts are begin and end alone and decode to the empty string. Rows that repeat
    are coded each; null ids stay null; other columns are ignored; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        frame = np.array([tool.bos, tool.eos], np.int32)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in _groups(texts):
                flat, lengths = tool.encode(texts[part])
                ends = np.cumsum(lengths)
                rows = [np.concatenate([frame[:1], flat[e - n:e], frame[1:]])
                        for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                decoded = tool.decode_all(np.concatenate(rows), lengths + 2)
                ids = batch.column("id").slice(part.start, part.stop - part.start)
                if digests:
                    yield pa.RecordBatch.from_arrays([
                        ids, pa.array([len(r) for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]),
                    ], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(rows, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                        ["id", "ids", "decoded"])

    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    rest = ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digests
            else "ids array<int>, decoded string")
    return source.mapInArrow(run, f"id {kind}, {rest}").withColumnRenamed("id", id_col)
