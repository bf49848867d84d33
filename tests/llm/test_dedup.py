"""SimHash, substring and byte dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from siftspark.llm import components, simhash, substring_dedup, suffix_dedup
from siftspark.llm.queries import queries


def fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_name_roots_and_long_chains(llm_spark):
    chain = list(range(40))
    random.Random(3).shuffle(chain)
    edges = [*zip(chain, chain[1:], strict=False), (50, 60), (60, 70), (50, 70), (80, 80)]
    got = {r["node"]: r["component"] for r in components.components(llm_spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 50: 50, 60: 50, 70: 50}


def test_components_of_nothing(llm_spark):
    assert components.components(llm_spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_links_of_planted_fingerprints(llm_spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:25]:  # chains of one and two bits, and pairs three bits apart
        for _ in range(rng.randrange(5)):
            for b in rng.sample(range(64), rng.choice((1, 2, 3))):
                v ^= 1 << b
            values.append(v)
    values = list(dict.fromkeys(values))
    rng.shuffle(values)
    want = groups(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2])
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.linked(llm_spark.createDataFrame([(v,) for v in signed], "fp bigint"), 2).collect()
    place = {v: i for i, v in enumerate(signed)}
    assert groups(len(values), [(place[r["a"]], place[r["b"]]) for r in links]) == want


def test_near_duplicates(table, odd_rows):
    got = simhash.near_duplicates(table(odd_rows)).collect()
    prints = [fingerprint(t) for _, t in odd_rows]
    known = [k for k, (i, _) in enumerate(odd_rows) if i is not None]
    found = groups(len(odd_rows), [(a, b) for a in known for b in known if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    want = [(i, f"{p:016x}", None if i is None else min(odd_rows[j][0] for j in known if found[j] == found[k]))
            for k, ((i, _), p) in enumerate(zip(odd_rows, prints, strict=True))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def windows_removed(rows, size):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - size + 1) if i is not None else ():
            key = tuple(words[k:k + size])
            first[key] = min(first.get(key, i), i)
    union = {}  # rows of one id lose what any of them loses
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - size + 1) if i is not None else ():
            if first[tuple(words[k:k + size])] < i:
                union.setdefault(i, set()).update(range(k, k + size))
    return [((i, len(w)), [x for k, x in enumerate(w) if k not in union.get(i, ())])
            for i, w in ((i, (t or "").encode().split()) for i, t in rows)]


@pytest.mark.parametrize("size", [7, 13])
def test_substring_dedup(table, odd_rows, size):
    got = substring_dedup.deduplicated(table(odd_rows), window=size, digests=True).collect()
    want = [(*head, head[1] - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for head, kept in windows_removed(odd_rows, size)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_substring_dedup_keeps_columns(table, odd_rows):
    docs = table(odd_rows)
    out = substring_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(odd_rows)
    assert {r["lang"] for r in out.collect()} == {"en"}


def bytes_removed(rows, size):
    seen, out = set(), []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - size + 1):
            if raw[k:k + size] in seen:
                gone[k:k + size] = True
            seen.add(raw[k:k + size])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((i, len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [2000, 3])
def test_suffix_dedup(table, odd_rows, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(8)
    line = "a line that a great many documents hold, word for word, and that is longer than a hundred bytes by far, to be sure. "
    rows = [r for r in odd_rows if r[0] != 5 and r[0] is not None]  # ids of the plain definition are distinct
    rows += [(100 + k, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(150))) + line * rng.randrange(1, 3)
              + "".join(rng.choice("abcdef ") for _ in range(rng.randrange(90)))) for k in range(40)]
    got = suffix_dedup.deduplicated(table(rows).repartition(5), digests=True).collect()
    assert sorted(map(tuple, got)) == sorted(bytes_removed(rows, 100))


def test_suffix_dedup_of_repeated_ids_and_nulls(table, odd_rows):
    docs = table([(1, "z" * 300), (1, "z" * 300), (None, "z" * 300), (2, "z" * 150)])
    got = sorted((tuple(r)[:4] for r in suffix_dedup.deduplicated(docs).collect()), key=str)
    assert got == sorted([(1, 300, 300 - 1, 1)] * 2 + [(None, 300, 0, 0), (2, 150, 150, 1)], key=str)


def test_suffix_dedup_tells_crowded_places_from_others_of_long_texts(table, llm_spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    rng = random.Random(31)

    def line(n):
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    crowded, cold = [line(150) for _ in range(300)], [line(150) for _ in range(240)]
    many = "".join(crowded)
    rows = [(1, many + line(66_000 - len(many)) + "".join(x + line(9) for x in cold))]
    rows += [(k, many) for k in (2, 3, 4)]
    rows += [(10 + k, "".join(x + line(7) for x in cold[k::8])) for k in range(8)]
    # Small tables would share one batch, where nothing is dealt.
    llm_spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix_dedup.deduplicated(table(rows), digests=True).collect()
    finally:
        llm_spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == sorted(bytes_removed(rows, 100))


def test_suffix_sort_is_a_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 4000, dtype=np.uint8)
    text = suffix_dedup.Suffixes(data)
    at = rng.permutation(3900)[:700].astype(np.int64)
    sizes = np.array([300, 1, 399])
    out = text.sorted_in_groups(at, np.cumsum(sizes) - sizes, sizes, np.full(3, 60))
    raw = data.tobytes()
    for start, n in zip(np.cumsum(sizes) - sizes, sizes, strict=True):
        assert out[start:start + n].tolist() == sorted(at[start:start + n].tolist(), key=lambda p: raw[p:p + 60])


def test_segments_of_one_anchor_tell_of_each_string():
    """Cuts of one passage of any begin and end, some of them copies, some spoiled at an edge: each string's earliest stays."""
    rng = random.Random(12)
    passage = bytes(rng.choice(b"abcd") for _ in range(164))
    parts, at, counts, lead = [], [], [], []
    for _ in range(400):
        begin, end = rng.choice([(0, 164), (rng.randrange(0, 30), rng.randrange(130, 165))])
        part = bytearray(passage[begin:end])
        if rng.random() < 0.5:
            part[rng.choice([0, 1, -1, -2])] = 122
        at.append(sum(map(len, parts)))
        counts.append(len(part) - 99)
        lead.append(64 - begin)
        parts.append(bytes(part))
    data = b"".join(parts)
    when = rng.sample(range(0, 10**6, 200), 400)
    got = suffix_dedup.Suffixes(np.frombuffer(data, np.uint8)).repeated_in_segments(
        np.array(at), np.array(counts), np.full(400, 7, np.uint64), np.array(lead), np.array(when), 100)
    strings = [(w + k, data[a + k:a + k + 100]) for a, n, w in zip(at, counts, when, strict=True) for k in range(n)]
    earliest = {}
    for w, s in strings:
        earliest[s] = min(w, earliest.get(s, w))
    assert got.tolist() == [w > earliest[s] for w, s in strings] and 0 < got.sum() < len(got)


def near(values, distance):
    return groups(len(values), [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= distance])


def crowd(rng, n):
    """Distinct fingerprints around a few centres: many pairs that share five bytes, fewer that are near."""
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = {}
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randrange(1, 5)):
            v ^= 1 << rng.randrange(64)
        out[v] = None
    return list(out)


def test_count_filtering_drops_pairs_and_loses_none():
    """Pairs of five-byte lists: some share no sixth byte and go before their bits are looked at."""
    rng = random.Random(4)
    key = rng.getrandbits(40) << 24
    fps = np.array(sorted({key | rng.getrandbits(24) for _ in range(300)}), np.uint64)
    low, high = np.triu_indices(len(fps), 1)
    enough = simhash.shared_bytes(fps[low], fps[high]) >= 6
    assert 0 < enough.sum() < 0.2 * len(low)
    want = {(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True) if (int(fps[a]) ^ int(fps[b])).bit_count() <= 2}
    got = simhash.retained(fps, low, high, 2)
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want
    strips = list(simhash._in_strips(fps, 2))
    assert {p for a, b in strips for p in zip(a.tolist(), b.tolist(), strict=True)} == want


@pytest.mark.parametrize("sizes", [(2, 3, 40), (400, 1, 2, 90)])
def test_lists_give_forests(sizes):
    rng = random.Random(7)
    lists = [crowd(rng, n) for n in sizes]
    flat = np.array([v for x in lists for v in x], np.uint64)
    a, b = simhash.links_in_lists(flat, np.array(sizes), 2)
    place = {(k, v): i for k, i, v in ((k, i, v) for k, x in enumerate(lists) for i, v in enumerate(x))}
    for k, x in enumerate(lists):
        own = [(place[k, u], place[k, v]) for u, v in zip(a.tolist(), b.tolist(), strict=True) if (k, u) in place and (k, v) in place]
        assert groups(len(x), own) == near(x, 2) and len(own) < len(x)


def test_long_lists_are_split(llm_spark, monkeypatch):
    monkeypatch.setattr(simhash, "LONG", 20)
    values = crowd(random.Random(9), 600)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    place = {v: i for i, v in enumerate(signed)}
    frame = llm_spark.createDataFrame([(v,) for v in signed], "fp bigint")
    first = simhash._meet(simhash._postings(frame, 5), 2, split=True)
    assert first.filter("choice IS NOT NULL").count() > 0
    links = simhash.linked(frame, 2).collect()
    assert groups(len(values), [(place[r["a"]], place[r["b"]]) for r in links]) == near(values, 2)


def test_one_of_each_group_stays(table, odd_rows):
    rng = random.Random(12)
    base = [f"w{k}" for k in range(400)]
    rows = list(odd_rows)
    for k in range(30):  # long texts with one word changed mostly stay within two bits
        own = list(base)
        own[rng.randrange(400)] = f"x{k}"
        rows.append((500 - k, " ".join(own)))
    docs = table(rows)
    out = simhash.without_near_duplicates(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted((r["doc_id"] for r in out.collect()), key=str)
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    assert got == sorted([*{c for c in component.values()}, *[None] * sum(i is None for i, _ in rows)], key=str)
    assert len(got) < len(rows) - 20


def test_repeated_ids_of_other_texts(table):
    far = " ".join(f"a{k}" for k in range(80))
    rows = [(5, far), (5, far), (5, "b c d e f g h"), (3, "b c d e f g h")]
    out = sorted((r["doc_id"], r["text"]) for r in simhash.without_near_duplicates(table(rows)).collect())
    assert out == [(3, "b c d e f g h"), (5, far)]


@pytest.mark.parametrize("name", ["op1_simhash", "op2_substring_dedup", "op9_suffix_dedup"])
def test_empty_tables(table, tmp_path, llm_spark, name):
    table([(1, "x")], extra=False).filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()[name](llm_spark, str(tmp_path)).count() == 0
