"""Token counts, the numpy codec and packing against the libraries themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftspark.llm import packing, sentencepiece_codec, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOOL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
WORD_TOOL = Tokenizer.from_file(WORDS)


def test_counts_of_all_kinds_of_text(table, odd_rows):
    for path, count in ((PIECES, lambda t: len(PIECE_TOOL.encode(t))),
                        (WORDS, lambda t: len(WORD_TOOL.encode(t, add_special_tokens=False).ids))):
        got = token_counts.token_counts(table(odd_rows), path, 100, chunk_chars=2000, overlap_chars=64).collect()
        want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 100) for i, t in odd_rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" ▁\nabth'é日🎉0\x00<s>", max_size=200), st.integers(10, 60), st.integers(1, 20))
def test_splicing_equals_one_encoding(text, chunk, overlap):
    lib = token_counts.library(PIECES)
    assert token_counts.spliced_ids(text, lib, chunk, overlap) == PIECE_TOOL.encode(text)
    lib = token_counts.library(WORDS)
    assert token_counts.spliced_ids(text, lib, chunk, overlap) == WORD_TOOL.encode(text, add_special_tokens=False).ids


def test_splicing_without_any_boundary():
    text = "ab" * 5000 + " " + "cd" * 5000
    assert token_counts.spliced_ids(text, token_counts.library(PIECES), 300, 20) == PIECE_TOOL.encode(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=80), max_size=5),
       st.lists(st.integers(0, 31_999), max_size=20))
def test_codec_is_the_library(texts, ids):
    codec = sentencepiece_codec.codec(PIECES)
    flat, lengths = codec.encode(texts)
    ends = np.cumsum(lengths)
    for text, end, n in zip(texts, ends, lengths, strict=True):
        assert flat[end - n:end].tolist() == PIECE_TOOL.encode(text)
    assert codec.decode(np.array(ids, np.int64)) == PIECE_TOOL.decode(ids)


def test_merge_rounds_on_repeats():
    codec = sentencepiece_codec.codec(PIECES)
    rng = random.Random(1)
    for text in ("aaaaaaa" * 40, "banana" * 30, "".join(rng.choice("abn") for _ in range(3000)), " " * 50):
        assert codec.encode([text])[0].tolist() == PIECE_TOOL.encode(text)


def test_coded_rows(table, odd_rows):
    got = sentencepiece_codec.coded(table(odd_rows), PIECES).collect()
    digests = sentencepiece_codec.coded(table(odd_rows), PIECES, digests=True).collect()
    want, hashed = [], []
    for i, t in odd_rows:
        ids = PIECE_TOOL.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, ids, PIECE_TOOL.decode(ids)))
        hashed.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256(PIECE_TOOL.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, digests), key=str) == sorted(hashed, key=str)


def test_chunked_encoder_is_the_library():
    tool = packing.encoder(WORDS)
    assert tool.by_chunk and not packing.Encoder(BYTES).by_chunk
    rng = random.Random(2)
    parts = [*" \t\n\x1c\x85\xa0　\x00ab1é'sS<|Ĺİß🎉日٠", "<|endoftext|>", "'re", "'S", "é", "ﬁ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(1500)]
    for ids, ref in zip(tool.encode(texts), WORD_TOOL.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == ref.ids


@pytest.mark.parametrize("counts", [[5, 0, 7, 9, 0, 0, 3, 2], [1000, 3, 0, 0, 1, 0, 0, 400], [0, 0, 0, 0, 0, 0, 0, 1]])
def test_plans_use_every_piece_once(counts):
    units = np.flatnonzero(counts) + 1
    n = np.array(counts)[units - 1]
    plan = packing.planned(units, n, 8)
    assert (plan.copies @ plan.patterns == n).all()
    assert (plan.patterns @ units <= 8).all()
    assert plan.copies.sum() <= -(-(units @ n) // 8) * 1.25 + 1


def test_packed_rows(table, odd_rows):
    rows = packing.packed(table(odd_rows), WORDS, 2, capacity=256, with_ids=True).collect()
    ids = {}
    for i, t in odd_rows:
        ids.setdefault(i, []).append([*WORD_TOOL.encode(t or "", add_special_tokens=False).ids, 2])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        assert any(r["ids"] == x[r["start"]:r["start"] + r["length"]] and r["doc_tokens"] == len(x) for x in ids[r["doc_id"]])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256


def test_empty_tables(table):
    empty = table([(1, "x")]).filter("false")
    assert packing.packed(empty, WORDS, 2).count() == 0
    assert token_counts.token_counts(empty, PIECES, 5).count() == 0
    assert sentencepiece_codec.coded(empty, PIECES).count() == 0


def test_chunks_are_looked_up_once_and_learnt_anew_after_an_error(monkeypatch):
    tool = packing.Encoder(WORDS)
    texts = ["One two TWO twos's x1y2 café 中文", "", "two three <s> It's"]
    want = [tool.tool.encode(t, add_special_tokens=False).ids for t in texts]
    with monkeypatch.context() as broken:
        broken.setattr(tool, "_learn_parts", lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            list(tool.encode(texts))
    for _ in range(2):
        assert [ids.tolist() for ids in tool.encode(texts)] == want
    assert not tool.known.taken() and len(tool.starts) == len(tool.known) + 1
