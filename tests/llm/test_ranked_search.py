"""Ranked search against scores of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siftspark.llm import ranked_search


def terms(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, k):
    bags = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, length = len(bags), sum(b.total() for _, b in bags)
    held = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 50 + (50 * b.total() * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[w] + 1))) * ((10**9 * b[w]) // (1000 * b[w] + 20 * m))
                        for w in set(terms(text)) if b[w])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, at + 1, i, -s) for at, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.fixture
def many(odd_rows):
    rng = random.Random(11)
    words = ["Erin", "than", "straße", "日本", "x1", "of", "the", "rare", "lich", "and"]
    copies = [(1000 - k, "than of the  Lich, rare!") for k in range(70)]  # a class larger than k, its ids in no order
    reordered = [(2000 + k, " ".join(rng.sample("than of the lich rare".split(), 5))) for k in range(20)]
    mixed = [(3000 + k, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in range(150)]
    return [*odd_rows, *copies, *reordered, *mixed, (4000, "than " * 200_000 + "rare")]


ITEMS = [(1, "Than RARE lich"), (2, "the of and"), (3, "日本 straße"), (4, "nowhere at all zz"), (5, ""), (6, None), (7, "erin erin x1 9"),
         (7, "erin erin x1 9"), (None, "lich")]


@pytest.mark.parametrize(("k", "block"), [(50, 500_000), (3, 500_000), (50, 4)])
def test_against_brute_force(table, llm_spark, many, k, block):
    items = llm_spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id bigint, text string, class string, score int")
    got = ranked_search.ranked(table(many), items, k, block_terms=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(many, ITEMS, k)


def test_no_rows(table, llm_spark):
    docs, items = table([(1, "a b")]), llm_spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for d, i in ((docs.filter("false"), items), (docs, items.filter("false")), (docs.selectExpr("doc_id", "'' AS text"), items)):
        out = ranked_search.ranked(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
    with pytest.raises(ValueError):
        ranked_search.ranked(docs, items, k=0)


def test_string_ids(llm_spark):
    docs = llm_spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z z")], "doc_id string, text string")
    items = llm_spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [tuple(r)[:3] for r in ranked_search.ranked(docs, items).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]


def test_tasks_keep_the_best_in_small_steps(monkeypatch):
    rng = np.random.default_rng(2)
    best = ranked_search.Best(3, 4)
    found = rng.integers(-2, 30, (400, 3))
    first = pa.array([None if x == 0 else int(x) for x in rng.integers(0, 60, 400)], pa.int64())
    for at in range(0, 400, 25):
        best.add(found[at:at + 25], first.slice(at, 25), np.arange(at, at + 25))
    table = best.close()
    for item in range(3):
        rows = sorted((-int(found[r, item]), first[r].as_py() is None, first[r].as_py() or 0) for r in range(400) if found[r, item] > 0)[:4]
        own = table.filter(pa.compute.equal(table["item"], item))
        assert [(-s, f is None, f or 0) for s, f in zip(own["score"].to_pylist(), own["first"].to_pylist(), strict=True)] == rows


def test_scores_in_small_steps(monkeypatch):
    items = ranked_search.Items(pa.array([5, 6]), [b"a", b"b", b"c"], np.array([0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    starts, term, count = np.array([0, 2, 2, 5]), np.array([0, 2, 0, 1, 2]), np.array([1, 4, 2, 2, 9])
    m, weight = np.array([50, 60, 70]), np.array([3, 500, 90])
    whole = ranked_search.scores(starts, term, count, m, weight, items)
    monkeypatch.setattr(ranked_search, "_EXPANDED", 1)
    assert (ranked_search.scores(starts, term, count, m, weight, items) == whole).all()
    assert whole[0, 1] == 3 * (10**9 // 2000) + 90 * (4 * 10**9 // 5000) and not whole[1].any()
