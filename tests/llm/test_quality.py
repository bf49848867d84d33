"""Rules, fingerprints, secrets and toxicity."""

import hashlib
import random
import re
import string
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftspark.llm import fingerprints, quality_rules, secret_scan, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_statistics(table, odd_rows):
    rows = [*odd_rows, (30, "a\nb\na\n\n \na"), (31, "# a|b <c>\n# a|b <c>"), (32, "p q r p q r p q"), (33, "a b c\x85d")]
    got = quality_rules.judged(table(rows), []).collect()
    want = []
    for i, t in rows:
        t = t or ""
        words = WORD.findall(t)
        grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
        covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want.append((i, len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)),
                     len(covered), failed, not failed))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_rules_are_found_and_run(table):
    rng = random.Random(1)

    def row():
        return {n: rng.random() for n in quality_rules.FEATURES}
    rows = [(r, r["symbol_rate"] > 0.8 or (r["upper_rate"] > 0.7 and r["n_words"] <= 0.5)) for r in (row() for _ in range(1500))]
    rules = quality_rules.learned(rows)
    fresh = [(r, r["symbol_rate"] > 0.8 or (r["upper_rate"] > 0.7 and r["n_words"] <= 0.5)) for r in (row() for _ in range(1500))]
    hit = [(any(quality_rules.matches(rule, r) for rule in rules), bad) for r, bad in fresh]
    assert sum(h == b for h, b in hit) / len(hit) > 0.95
    assert "when" in quality_rules.verdict(rules)._jc.toString().lower()


def test_rules_without_labels_keep(table):
    docs = table([(k, "word " * 3 + " ".join(f"w{k}x{j}" for j in range(60))) for k in range(5)])
    labels = docs.select("doc_id", F.lit(1).alias("quality")).filter("false")
    assert quality_rules.fitted(docs, labels, "quality") == []
    assert {r["kept"] for r in quality_rules.judged(docs, []).collect()} == {True}


def test_edited_texts_and_likeness(table, odd_rows):
    docs = table(odd_rows)
    got = fingerprints.edited_likeness(docs).collect()
    assert len(got) == len(odd_rows)
    distinct = sorted(set(odd_rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    nulls = [r for r in distinct if r[0] is None]  # two texts of the null id: their order is that of a hash
    rows = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    known = [r for r in distinct if r[0] is not None]
    for k, (i, t) in enumerate(known[:-1]):
        t, following = t or "", known[k + 1][1] or ""
        m = len(t) // 3
        edited = t[:len(t) - m] + following[:m]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len(nulls) == 2
    prints = {}
    for r in fingerprints.fingerprints(docs).collect():
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[4] == prints[5] and len(prints[4]) == 1 and prints[1] == prints[2] == prints[3]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_edited_texts_move_once(table, odd_rows, llm_spark):
    """Groups lie as the joins behind them need them, and digits move as bytes."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = llm_spark.conf.get(name)
    llm_spark.conf.set(name, "-1")
    try:
        plan = fingerprints.edited_likeness(table(odd_rows))._jdf.queryExecution().executedPlan().toString()
    finally:
        llm_spark.conf.set(name, before)
    assert plan.count("Exchange hashpartitioning") == 4
    assert "fingerprint:binary" in plan and "fingerprint:string" not in plan


def test_likeness_estimates(table, llm_spark):
    rng = random.Random(2)
    pairs, errors = [], []
    for k in range(40):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(400)]
        other = words[:(k * 10)] + [f"v{rng.randrange(10 ** 6)}" for _ in range(400 - k * 10)]
        pairs.append((k, " ".join(words), " ".join(other)))
    frame = llm_spark.createDataFrame(pairs, "k int, x string, y string").selectExpr(
        "k", f"{fingerprints.fingerprint('x')} AS p", f"{fingerprints.fingerprint('y')} AS q")
    for r in frame.selectExpr("k", f"{fingerprints.likeness('p', 'q')} AS near").collect():
        a, b = ({tuple(t.split()[j:j + 5]) for j in range(396)} for t in pairs[r["k"]][1:])
        errors.append(r["near"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_likeness_of_short_texts(llm_spark):
    """Unrelated texts of 1 to 12 words are not alike, and related ones as alike as their shingles."""
    rng = random.Random(13)
    unrelated, related = [], []
    for n in range(1, 13):
        for k in range(60):
            unrelated.append((n, *(" ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n)) for _ in range(2))))
            words = [f"w{rng.randrange(10 ** 9)}" for _ in range(n + 8)]
            related.append((n, " ".join(words), " ".join([*words[:-(k % 4 + 1)], "other"])))

    def likenesses(pairs):
        frame = llm_spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, n int, x string, y string").selectExpr(
            "k", f"{fingerprints.fingerprint('x')} AS p", f"{fingerprints.fingerprint('y')} AS q")
        # Without the floor at zero, so that the mean tells a bias.
        raw = fingerprints.likeness("p", "q").removeprefix("greatest(0D, ").removesuffix(")")
        return [r["near"] for r in frame.selectExpr("k", f"{raw} AS near").orderBy("k").collect()]
    near = np.array(likenesses(unrelated))
    assert near.max() < 0.2 and abs(near.mean()) < 0.01
    errors = []
    for (_, x, y), got in zip(related, likenesses(related), strict=True):
        a, b = ({tuple(t.split()[j:j + 5]) for j in range(len(t.split()) - 4)} for t in (x, y))
        errors.append(got - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02


def test_near_next_follows_the_shingles(table):
    rng = random.Random(17)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(30):
        own = base[:300 - 10 * k] + [f"x{rng.randrange(10 ** 9)}" for _ in range(10 * k)]
        rows.append((k, " ".join(own)))
    got = {r["doc_id"]: r["near_next"] for r in fingerprints.edited_likeness(table(rows, extra=False)).collect()}
    errors = []
    for k in range(1, 30):
        a, b = ({tuple(t.split()[j:j + 5]) for j in range(296)} for t in (rows[k][1], rows[k - 1][1]))
        errors.append(got[k] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


BASE = (
    ("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))


def base_spans(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, g, n) in enumerate(BASE) for m in p.finditer(text) if len(m.group(g)) >= n]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(spans))


def test_base_spans(table, odd_rows):
    texts = [
        "🎉 Password='abcdefg' token: x1 SECRET=abc token=token: abcdefgh", "AKIA" + "A1" * 8 + " AKIA1 AKIAAKIA" + "B" * 14,
        "00ff" * 6 + " " + "0f" * 11 + "x" + "ab" * 30, "api_key = \"k.k/k+k=k\" apikey:'zzzzzz", "token=" + "0123456789abcdef" * 2 + "\ntoken=abcde",
    ]
    rows = [*odd_rows, *((200 + k, t) for k, t in enumerate(texts))]
    got = secret_scan.report(table(rows)).collect()
    want = [(i, hashlib.sha256(base_spans(t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in got) == sum(len(s.split(",")) for s in (base_spans(t or "") for _, t in rows) if s)


def test_random_tokens_are_found_and_words_are_not(table):
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits
    secrets = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(60)]
    plain = ["".join(rng.choice(("the", "lich", "keit", "tion")) for _ in range(8)) for _ in range(60)]
    plain += ["/".join(rng.choice(("users", "docs", "photos2024")) for _ in range(4)) for _ in range(20)] + ["-" * 40, "1" * 40]
    docs = table([(k, f"see {s} here") for k, s in enumerate(secrets + plain)])
    found = {r["doc_id"] for r in secret_scan.report(docs).collect() if "random" in r["spans"]}
    assert len(found & set(range(60))) >= 54 and not found - set(range(60))
    out = secret_scan.without_secrets(docs)
    assert out.columns == docs.columns
    masked = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(masked[k] == "see [secret] here" for k in found) and masked[61] == f"see {plain[1]} here"


def drawn(rng, encoding):
    hexa, lower, upper = "0123456789abcdef", string.ascii_lowercase, string.ascii_uppercase
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    b32 = upper + "234567"
    return {
        "base62": lambda: pick(string.ascii_letters + string.digits, 32), "base64": lambda: pick(string.ascii_letters + string.digits + "+/", 42) + "==",
        "base64url": lambda: pick(string.ascii_letters + string.digits + "-_", 43), "upper hex": lambda: pick(hexa.upper(), 40),
        "uuid": lambda: "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), "base32": lambda: pick(b32, 32) + "======",
        "prefixed": lambda: "sk-" + pick(lower + string.digits, 32), "twice prefixed": lambda: "sk_live_" + pick(string.ascii_letters + string.digits, 24),
        "mixed letters": lambda: pick(string.ascii_letters, 32), "lower letters": lambda: pick(lower, 48), "keyed hex": lambda: "key-" + pick(hexa.upper(), 32),
    }[encoding]()


ENCODINGS = ("base62", "base64", "base64url", "upper hex", "uuid", "base32", "prefixed", "twice prefixed", "mixed letters", "lower letters", "keyed hex")
PLAIN = ("the", "lich", "keit", "tion", "Straße", "über", "order", "Service", "Impl", "return", "photos", "2024", "user", "DATA", "config", "12")


def test_every_encoding_is_found_and_no_plain_token(table):
    rng = random.Random(9)
    rows, kinds = [], {}
    for e in ENCODINGS:
        for _ in range(60):
            kinds[len(rows)] = e
            rows.append((len(rows), f"a text with {drawn(rng, e)} in it"))
    n = len(rows)
    for _ in range(1500):
        joint = rng.choice(("", "", "-", "_", "/"))
        rows.append((len(rows), joint.join(rng.choice(PLAIN) for _ in range(rng.randrange(4, 12)))))
    rows += [(len(rows) + k, t) for k, t in enumerate((
        "abcdefghijklmnopqrstuvwxyz0123456789", "-" * 40, "1" * 40, "0123456789" * 4, "ABAB" * 12, "qwertyuiopasdfghjklzxcvbnm" * 2,
        "x" * 21 + "y" * 21, "aB" * 20, "/usr/local/share/applications/default", "2024-01-01_2024-12-31_2025-06-30"))]
    found = {r["doc_id"] for r in secret_scan.report(table(rows, extra=False)).collect() if "random" in r["spans"]}
    assert not [rows[k] for k in found if k >= n]
    share = {e: sum(kinds[k] == e for k in found) / 60 for e in ENCODINGS}
    assert min(share.values()) >= 0.9, share


def test_long_texts_with_many_tokens(table):
    import time
    rng = random.Random(3)
    text = " ".join("".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24)) for _ in range(20_000))
    started = time.time()
    out = secret_scan.without_secrets(table([(1, text), (2, "é" * 5000 + " password=hunter22 🎉" + "x" * 9000)], extra=False)).collect()
    assert time.time() - started < 40
    got = {r["doc_id"]: r["text"] for r in out}
    assert got[1].count("[secret]") > 19_000 and got[2] == "é" * 5000 + " [secret] 🎉" + "x" * 9000


def test_masks_of_overlapping_spans(llm_spark):
    text = "".join(chr(97 + k % 26) for k in range(10_000))
    spans = [(0, 3), (2, 5), (5, 6), (4000, 4200), (4095, 4097), (8191, 8193), (9000, 9999)]
    frame = llm_spark.createDataFrame([(text, [(a, b, 0) for a, b in spans])], "t string, sp array<struct<s:int,e:int,k:int>>")
    got = frame.selectExpr(secret_scan.masked("t", "sp", "#") + " AS m").first()["m"]
    at, want = 0, ""
    for a, b in spans:
        if a >= at:
            want += text[at:a] + "#"
        at = max(at, b)
    assert got == want + text[at:]


def test_tokens_beside_base_spans(llm_spark):
    frame = llm_spark.createDataFrame([([(5, 9, 0), (20, 60, 0), (25, 30, 1)], [(0, 5, 3), (6, 8, 3), (9, 12, 3), (15, 21, 3), (50, 55, 3), (60, 70, 3)])],
                                      "base array<struct<s:int,e:int,k:int>>, tokens array<struct<s:int,e:int,k:int>>")
    got = frame.selectExpr(secret_scan._apart("base", "tokens") + " AS t").first()["t"]
    assert [(x["s"], x["e"]) for x in got] == [(0, 5), (9, 12), (60, 70)]


def test_secrets_of_an_empty_table(table):
    assert secret_scan.report(table([(1, "x")]).filter("false")).count() == 0
    assert fingerprints.edited_likeness(table([(1, "x")]).filter("false")).count() == 0


def labelled(n, seed):
    rng = random.Random(seed)
    plain = [f"w{k}" + rng.choice(("er", "ing", "tion")) for k in range(150)]
    bad = ["idiot", "moron", "worthless", "scumbag"]
    rows = []
    for k in range(n):
        toxic = k % 5 == 0
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        if toxic:
            for _ in range(3 + len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_toxicity_held_out_and_misspelled(table, odd_rows, llm_spark):
    rows = labelled(600, 1)
    labels = llm_spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    model = toxicity.fitted(table([(i, t) for i, t, _ in rows]), labels, "toxic")
    fresh = labelled(300, 2)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(table([(i, t) for i, t, _ in fresh]), model).collect()}
    assert sum((scores[i] >= 0.5) == (y == 1) for i, _, y in fresh) / len(fresh) > 0.95
    near = model.of_words([b"idiott", b"w3tion"])
    assert near[0] > 5 * abs(near[1])
    odd = toxicity.scored(table(odd_rows), model).collect()
    assert len(odd) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.without_toxic(table([(i, t) for i, t, _ in fresh] + odd_rows), model)
    assert 0.75 * 300 < kept.count() - len(odd_rows) < 0.85 * 300


def test_toxicity_without_labels(table, llm_spark):
    labels = llm_spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.fitted(table([(1, "x")]), labels, "toxic")
    assert toxicity.scored(table([(1, "x"), (2, None)]), model).count() == 2
    assert toxicity.scored(table([(1, "x")]).filter("false"), model).count() == 0


def test_toxicity_scores_many_words_in_little_memory():
    weights = np.random.default_rng(3).normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    model = toxicity.Model(weights, 0.1)
    texts = [" ".join(f"word{k}x{j}" for j in range(150)) if k % 50 else None for k in range(1_000)]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
    taken = {}

    class Docs:
        schema = None

        def mapInArrow(self, run, schema):
            taken["run"] = run

    toxicity.without_toxic(Docs(), model, limit=0.5)
    tracemalloc.start()
    out = list(taken["run"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6      # 223 MB when the words of 1,000 texts were scored at once
    want = [i for i, t in enumerate(texts) if model.scores([t or ""], {})[0] < 0.5]
    assert pa.Table.from_batches(out).column("doc_id").to_pylist() == want and 0 < len(want) < len(texts)
    cut = pa.array(["x" * (toxicity.SLICE_BYTES + 1), None, "", "y", "z" * toxicity.SLICE_BYTES, "w"])
    assert list(toxicity._slices(cut)) == [(0, 1), (1, 4), (5, 1)] and list(toxicity._slices(cut[:0])) == []
