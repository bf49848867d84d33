"""The license scan against every word of every text and every notice."""

import random
import re

import numpy as np
import pytest

from siftspark.llm import licenses
from siftspark.llm.queries import queries


def brute(text, containment=licenses.CONTAINMENT):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    blocks = []
    for n in licenses.notices_of(licenses.NOTICES, containment):
        wanted = {w.decode() for w in n.words}
        for start in range(0, len(words), n.layer):
            shared = len(wanted & set(words[start:start + 2 * n.layer]))
            if shared >= n.need:
                blocks.append((n.label, start, min(start + 2 * n.layer, len(words)), shared / len(wanted)))
    at = [i for i, _ in places]
    labels = {label for _, label in places}
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {b[0] for b in blocks})), 1.0 if places else max((b[3] for b in blocks), default=0.0), sorted(blocks))


def planted():
    rng = random.Random(8)
    filler = ["the", "of", "and", "software", "license", "copies", "you", "may", "not", "straße", "42", "use", "public"]
    rows = []
    for k in range(60):
        label, text = licenses.NOTICES[k % len(licenses.NOTICES)]
        words = text.split()
        for _ in range(k // len(licenses.NOTICES)):  # spoilt more and more
            words[rng.randrange(len(words))] = rng.choice(filler)
        ahead, behind = ([rng.choice(filler) for _ in range(rng.randrange(150))] for _ in range(2))
        rows.append((100 + k, " ".join([*ahead, *words, *behind])))
    return [*rows, (200, "MIT License, cc-by; Apache  LICENSE!\nGNU General-Public\tLicense mit license"), (201, "licensed under cc-by-nc 4.0"),
            (202, "mit"), (203, "gnu general public"), (204, " ".join(["license"] * 5000 + ["CC BY"]))]


def test_against_brute_force(table, odd_rows):
    rows = odd_rows + planted()
    got = licenses.scanned(table(rows)).collect()
    have = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"],
                    sorted((b["label"], b["start"], b["stop"], b["share"]) for b in r["blocks"])) for r in got), key=str)
    assert have == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert sum(bool(r["blocks"]) for r in got) > 20


@pytest.mark.parametrize("containment", [0.5, 0.75, 1.0])
def test_filters_lose_nothing(containment):
    """The join of random sets of common words, with an order that the words' frequency does not follow."""
    rng = np.random.default_rng(3)
    notices = tuple((f"n{k}", " ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(2, 30)))) for k in range(12))
    found = licenses.notices_of(notices, containment)
    known = {w: k for k, w in enumerate(sorted({w for n in found for w in n.words}))}
    rank = rng.permutation(len(known))
    tok = rng.integers(0, len(known), 4_000)
    row, pos = np.repeat(np.arange(4), 1_000), np.tile(np.arange(1_000), 4)
    got, want = set(), set()
    for layer in licenses.layers_of(found, known, rank):
        got |= {(int(r), int(b), layer.step, layer.labels[t], int(s)) for r, b, t, s in zip(*licenses.joined(row, pos, rank[tok], layer), strict=True)}
    for n in found:
        wanted = {known[w] for w in n.words}
        for r in range(4):
            for b in range(-(-1_000 // n.layer)):
                shared = len(wanted & set(tok[row == r][b * n.layer:(b + 2) * n.layer].tolist()))
                if shared >= n.need:
                    want.add((r, b, n.layer, n.label, shared))
    assert got == want and want


def test_words_of_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(licenses, "_PIECE", 7)
    text = "Ab1 ünder--x 日本語 a" * 50 + "y" * 40
    assert [w for p in licenses.pieces(text) for w in p] == licenses.words_of(text)
    assert list(licenses.pieces("")) == []


def test_odd_parameters():
    with pytest.raises(ValueError):
        licenses.notices_of((("x", "..."),), 0.9)
    with pytest.raises(ValueError):
        licenses.notices_of(licenses.NOTICES, 0.0)


def test_no_rows_and_own_phrases(table):
    assert licenses.scanned(table([(1, "x")]).filter("false")).collect() == []
    own = licenses.scanned(table([(1, "Foo bar foo bar")]), phrases={"foo bar": "z"}, notices=()).first()
    assert (own["n_base"], own["first_word"], own["last_word"], own["labels"]) == (2, 0, 2, "z")


def test_registered(llm_spark):
    assert "op13_license_scan" in queries()
