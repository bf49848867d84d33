import random
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
# Names that operators use inside; a user's table may have any of them.
CLASHING = ("id", "h", "pos", "n", "fp", "d", "k", "row", "rest", "score", "digest", "node", "component", "key", "a", "b",
            "places", "lists", "runs", "unit", "rank", "slot", "base", "spans", "tokens", "th", "part", "label", "kept")


@pytest.fixture(scope="session")
def llm_spark(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT
    return spark


@pytest.fixture(scope="session")
def table(llm_spark):
    """documents from (doc_id, text) rows, with extra columns whose names clash."""
    def build(rows, extra=True):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        if extra:
            schema += "".join(f", `{c}` string" for c in CLASHING)
            full = [(*r, *(["x"] * len(CLASHING))) for r in full]
        return llm_spark.createDataFrame(full, schema)
    return build


WORDS = ["the", "of", "erin", "than", "keit", "över", "écha", "lich", "tion", "Ñandú", "日本", "stand", "over", "ring"]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, shared passages, near copies."""
    rng = random.Random(4)

    def text(n):
        return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    shared, base = text(30), text(120)
    near = base.split()
    near[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, base), (5, base), (5, base), (7, " ".join(near)),
        (8, f"{text(20)} {shared} {text(25)}"), (9, f"{text(10)}\n{shared}\n{text(9)}"), (10, shared),
        (11, "one two"), (12, "one two"), (13, "a " * 60), (14, "ab" * 30_000), (15, text(9000)),
        (16, f"{shared} {shared}"), (17, "x y\x00z 🎉 ▁ é"), (None, base), (None, None), (20, text(70)),
    ]
