"""The prefix trie against a trie built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from siftspark.llm import conversation_trie


def said(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()


def brute(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, said(role, text), len(text or ""), role or "", text or ""))
    for c in turns:
        turns[c].sort()
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        g = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = [x[4:] for x in turns.get(g, [])[:h] + turns[c][h:]]
    nodes = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ended = ",".join(str(c) for c in sorted(c for c in members if len(whole[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], leaves[p], saved[p],
                    hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id bigint, turn bigint, role string, text string, c string, depth string, n string, owner string"


def result(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    return sorted(map(tuple, conversation_trie.trie(table, **options).collect()), key=str)


def some(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 900), 150):
        for t in range(rng.choice((0, 1, 2, 3, 5, 8))):
            rows.append((c, rng.choice((None, t, t)), rng.choice(("user", "assistant", None, "")), rng.choice(("a", "b", None, "", "日本 é", "longer text"))))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(llm_spark, seed):
    rows = some(seed)
    assert result(llm_spark, rows) == brute(rows)


def test_a_full_sketch_changes_nothing(llm_spark):
    rows = some(4)
    assert result(llm_spark, rows, cells=conversation_trie.SLICES) == brute(rows)


def test_copies_long_conversations_and_odd_rows(llm_spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "RUN", 7)
    monkeypatch.setattr(conversation_trie, "_JOINED", 40)
    rng = random.Random(6)
    long = [(t, "user", rng.choice("ab") * 3) for t in range(300)]
    rows = [(c, *x) for c in (700, 733, 741) for x in long]  # conversations that many tasks share
    rows += [(733, 301, "user", "more"), (741, 400, "user", "else"), (741, 401, "user", "x")]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(4)]  # a large group of copies
    rows += [(5, 1, "user", "tie")] * 6 + [(5, 1, None, "tie"), (5, None, "a", "bc"), (6, None, "ab", "c"), (6, 1, "", None), (None, 1, "user", "lost")]
    rows += [(2**62, 0, "user", "far"), (-7, 0, "user", "below"), (7 * 100 + 99, None, "", "")]
    rng.shuffle(rows)
    assert result(llm_spark, rows) == brute(rows)


def test_no_rows(llm_spark):
    assert result(llm_spark, []) == []
    assert result(llm_spark, [(None, 1, "user", "x")]) == []
    with pytest.raises(ValueError):
        conversation_trie.trie(llm_spark.createDataFrame([], SCHEMA), cells=100)


def test_a_sketch_never_counts_too_low(llm_spark):
    rows = [(k % 50, k * k % 17) for k in range(400)]
    counts = conversation_trie.sketch(llm_spark.createDataFrame(rows, "k1 bigint, k2 bigint"), 64)
    import numpy as np
    k1, k2 = np.array(rows, np.int64).T
    least = counts[conversation_trie.cells_of(k1.copy(), k2.copy(), 64)].min(axis=0)
    times = {r: rows.count(r) for r in rows}
    assert all(e >= min(2, times[r]) for e, r in zip(least, rows, strict=True))
