"""Requests over several files, and the durable exchange with a reviewer."""

import json
import re

import pandas as pd
import pytest

from siftspark.operators import exchange, external, snippets
from siftspark.options import ScanOptions
from siftspark.sources.catalog import built_in_catalog


def asked(spark, folder):
    return sorted((r["request_id"], r["attempt"]) for r in exchange.events_of(spark, folder).where("state = 'asked'").collect())


def replies(batches):
    """Says JSON to good ones, to slow ones on the second attempt, never to bad ones, nothing to mute ones."""
    for batch in batches:
        batch = batch[batch["request_id"] != "mute"]
        bad = (batch["request_id"] == "bad") | ((batch["request_id"] == "slow") & (batch["attempt"] == 1))
        texts = ["???" if b else json.dumps({"findings": [], "attempt": int(a)}) for b, a in zip(bad, batch["attempt"], strict=True)]
        yield pd.DataFrame({"request_id": batch["request_id"].tolist(), "text": texts}, dtype=object)


def broken(batches):
    raise RuntimeError("the reviewer is away")


@pytest.fixture
def requests(spark):
    rows = [("r", i, f"prompt {i}") for i in ("good", "slow", "bad", "mute", "known", "good")]
    return spark.createDataFrame(rows, "repo string, request_id string, prompt string")


def test_states_of_requests(spark, requests, tmp_path):
    folder = str(tmp_path / "events")
    known = spark.createDataFrame([("known", '{"findings": []}'), ("other", "{}"), ("good", "no json")], "request_id string, text string")
    for _ in range(2):      # a second run asks nothing but what is still without an answer
        found = exchange.exchange(requests, replies, folder, known)
        got = {r["request_id"]: (r["state"], r["attempts"]) for r in found.collect()}
    assert got == {"good": ("answered", 1), "slow": ("answered", 2), "bad": ("bad", 2), "mute": ("asked", 2), "known": ("answered", 0)}
    assert found.count() == 6      # two rows ask the same
    assert [a for a in asked(spark, folder) if a[0] != "mute"] == [("bad", 1), ("bad", 2), ("good", 1), ("slow", 1), ("slow", 2)]
    text = {r["request_id"]: r["text"] for r in found.collect()}
    assert json.loads(text["slow"])["attempt"] == 2 and text["bad"] is None


def test_a_run_that_broke_off_goes_on(spark, requests, tmp_path):
    folder = str(tmp_path / "events")
    with pytest.raises(Exception, match="away|Python"):
        exchange.exchange(requests, broken, folder)
    assert {r["state"] for r in exchange.states(exchange.events_of(spark, folder)).collect()} == {"asked"}
    found = exchange.exchange(requests, replies, folder)
    assert {r["request_id"]: r["state"] for r in found.collect()}["good"] == "answered"


def test_events_merge_in_any_order(spark):
    rows = [("a", "answered", 2, "second"), ("a", "bad", 1, "x"), ("a", "asked", 2, None), ("a", "answered", 1, "first"),
            ("b", "asked", 1, None), ("b", "open", 0, None), ("b", "asked", 1, None), ("c", "bad", 2, "y"), ("c", "asked", 2, None)]
    for order in (rows, rows[::-1], rows + rows):
        got = {tuple(r) for r in exchange.states(spark.createDataFrame(order, exchange.EVENTS)).collect()}
        assert got == {("a", "answered", 2, "first"), ("b", "asked", 1, None), ("c", "bad", 2, None)}


def test_no_requests(spark, tmp_path):
    none = spark.createDataFrame([], "repo string, request_id string, prompt string")
    assert exchange.exchange(none, replies, str(tmp_path / "events")).count() == 0


@pytest.mark.parametrize("limit", [1, 3, 40])
def test_bins_hold_the_snippets_in_rank_order(spark, limit):
    options = ScanOptions(block_mode="window", max_snippets=limit)
    text = "logger.info(password)\n" + "x = 1\n" * 30 + "login(user)\n" + "y = 2\n" * 30 + "logger.warn(token)\n"
    rows = [(f"r{k % 2}", f"f{k:02}.py", "python", text if k % 3 else "pass\n") for k in range(12)]
    files = spark.createDataFrame(rows, "repo string, path string, language string, text string").repartition(5)
    found = external.prompt_bins(files, built_in_catalog(spark), options).collect()
    want = {}
    for r in snippets.snippets(files, options).orderBy("repo", "phase", "path", "seq").collect():
        want.setdefault(r["repo"], []).append((r["path"], r["start_line"]))
    for repo, places in want.items():
        bins = sorted((r for r in found if r["repo"] == repo), key=lambda r: r["batch"])
        assert [r["batch"] for r in bins] == list(range(1, -(-len(places) // limit) + 1))
        sent = []
        for r in bins:
            held = json.loads(r["prompt"].split("Snippets:\n", 1)[1])
            assert len(held) == r["snippets"] <= limit
            sent += [(s["path"], s["start_line"]) for s in held]
        assert sent == places
    assert len({r["request_id"] for r in found}) == len(found)
    assert external.prompt_bins(files.where("false"), built_in_catalog(spark), options).count() == 0


def test_rounds_and_bins_move_no_text_twice(spark, requests, tmp_path):
    folder = str(tmp_path / "events")
    exchange.exchange(requests, replies, folder)
    assert spark.read.parquet(f"{folder}-round-1").columns == ["request_id"]
    files = spark.createDataFrame([("r", "a.py", "python", "logger.info(password)\n")], "repo string, path string, language string, text string")
    bins = external.prompt_bins(files, built_in_catalog(spark), ScanOptions(block_mode="window"))
    dealt = re.findall(r"hashpartitioning\(repo#\d+, (\w+)#", bins._jdf.queryExecution().executedPlan().toString())
    assert "bin" in dealt and "phase" not in dealt      # snippets go to their bins, not to their ranks before
