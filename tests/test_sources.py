import hashlib
import json

import pytest

from siftspark.functions.text import split_lines
from siftspark.options import ScanOptions
from siftspark.plans.scan import scan
from siftspark.sources import files as S
from siftspark.sources.catalog import built_in_catalog, read_catalog, read_labels
from siftspark.sources.catalog_values import RULES

SMALL = ScanOptions(max_file_bytes=1024)


@pytest.fixture
def tree(tmp_path):
    def write(path, content):
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
    write("app.py", "print('ok')\n")
    write("ignored.py", "print('skip')\n")
    write("deep/er/Main.JAVA", "class Main {}\n")
    write("node_modules/x/lib.py", "x = 1\n")
    write("old/a/b.py", "x = 1\n")
    write("binary.py", b"\x00\x01\x02")
    write("large.py", "x" * 2000)
    write("bad.py", b"name = '\xff\xfe'\n")
    write("notes.txt", "print()\n")
    write(".py", "x\n")
    write(".scanignore", "# comment\n\nignored.py\nold/\n")
    return tmp_path


def test_directory_scan(spark, tree):
    raw = S.read_directory(spark, str(tree), "demo")
    globs = S.load_ignores(spark, str(tree), SMALL)
    assert globs[-2:] == ("ignored.py", "old/")
    files = {r.path: r for r in S.collect_files(raw, SMALL, globs).collect()}
    assert sorted(files) == ["app.py", "bad.py", "deep/er/Main.JAVA"]
    assert files["deep/er/Main.JAVA"].language == "java"
    assert files["app.py"].file_hash == hashlib.sha256(b"print('ok')\n").hexdigest()
    assert files["bad.py"].text == b"name = '\xff\xfe'\n".decode("utf-8", "replace")
    ledger = {r.path: (r.reason, r.note) for r in S.skip_ledger(raw, SMALL, globs).collect()}
    assert sorted(ledger) == ["binary.py", "large.py"]
    assert ledger["binary.py"] == (
        "binary", "binary.py: skipped because it appears to be binary")
    assert ledger["large.py"][1].endswith("size exceeds 1024 bytes")


def test_single_file_root(spark, tree):
    rows = S.collect_files(S.read_directory(spark, str(tree / "app.py")), SMALL).collect()
    assert [r.path for r in rows] == ["app.py"]


def test_oversized_content_is_not_read(spark, tree):
    rows = {r.path: r.content for r in S.read_directory(spark, str(tree), options=SMALL).collect()}
    assert rows["large.py"] is None and bytes(rows["app.py"]) == b"print('ok')\n"


def test_names_spark_readers_skip(spark, tmp_path):
    for name in ("__init__.py", "_p/x.py", ".hidden/y.py", ".git/z.py", "node_modules/q.py"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text("x = 1\n")
    rows = S.collect_files(S.read_directory(spark, str(tmp_path))).collect()
    assert sorted(r.path for r in rows) == [".hidden/y.py", "__init__.py", "_p/x.py"]


def test_many_directories(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / f"d{i % 7}" / f"e{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f{i}.py").write_text("x = 1\n" * (i + 1))
    rows = S.read_directory(spark, f"file://{tmp_path}", "r").collect()
    assert len(rows) == 60 and {r.length for r in rows} == {6 * (i + 1) for i in range(60)}


def test_file_limit(spark, tree):
    options = ScanOptions(max_files=1)
    raw = S.read_directory(spark, str(tree))
    assert [r.path for r in S.collect_files(raw, options).collect()] == ["app.py"]
    notes = [r.note for r in S.skip_ledger(raw, options).collect()]
    assert notes == ["File limit reached at 1; remaining supported files were skipped."]
    many = ScanOptions(max_files=100)
    assert "limit" not in {r.reason for r in S.skip_ledger(raw, many).collect()}


@pytest.mark.parametrize("size,line,expected", [
    (20_000, 1001, True), (20_000, 1000, False), (19_999, 1500, False)])
def test_minified(spark, size, line, expected):
    body = (b"x" * line + b"\n") + b"y = 1\n" * ((size - line) // 6 + 1)
    raw = spark.createDataFrame([("r", "a.py", size, body[:size])],
                                "repo string, path string, length long, content binary")
    reason = S.file_quality(raw).head().skip_reason
    assert (reason == "minified") is expected


@pytest.mark.parametrize("glob,path,hit", [
    ("*.min.py", "a/b.min.py", True), ("docs/*", "docs/x/y.py", True), ("gen", "a/gen/b.py", True),
    ("a/", "a/b.py", True), ("a/", "b/a/c.py", False), ("x[0-9].py", "d/x7.py", True),
    ("x[!0-9].py", "d/x7.py", False), ("?.py", "ab.py", False), ("**/lib/**", "lib/a.py", True),
    ("/top.py", "top.py", True), ("top.py", "sub/top.pyc", False)])
def test_globs(spark, glob, path, hit):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.selectExpr(f"{S.ignored('path', (glob,))} AS i").head().i is hit


@pytest.mark.parametrize("path,language", [
    ("a.py", "python"), ("A.JAVA", "java"), ("a.json", None), (".py", None), ("d/.java", None),
    ("a.py.txt", None)])
def test_language(spark, path, language):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.selectExpr(f"{S.language_of('path')} AS l").head().l == language


def test_language_exclusion(spark):
    df = spark.createDataFrame([("a.py",), ("B.java",)], "path string")
    rows = S.language_filter(df, ScanOptions(languages_exclude=("java",))).collect()
    assert [r.path for r in rows] == ["a.py"]


@pytest.mark.parametrize("text", [
    "", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f ", "\r\n", "a\n\r"])
def test_split_lines_is_splitlines(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert list(df.selectExpr(f"{split_lines('t')} AS l").head().l) == text.splitlines()


def test_catalogs(spark, tmp_path):
    path = tmp_path / "rules.json"
    short = {k: v for k, v in RULES[0].items() if k not in ("languages", "deterministic_signals")}
    path.write_text(json.dumps({"version": "1", "rules": [short, RULES[1]]}))
    rows = {r.id: r for r in read_catalog(spark, str(path)).collect()}
    assert rows["LOG-001"].languages == [] and rows["LOG-002"].languages == ["python", "java"]
    own = built_in_catalog(spark).collect()
    assert [r.id for r in own] == [r["id"] for r in RULES]
    assert own[2].source_refs[0].line_start == 349


def test_labels(spark, tmp_path):
    path = tmp_path / "labels.json"
    path.write_text(json.dumps({"cases": [
        {"path": "a.py", "expected": [{"rule_id": "LOG-003", "line": 7}]},
        {"path": "b.py", "expected": []}]}))
    rows = sorted((r.case, r.rule_id, r.line) for r in read_labels(spark, str(path)).collect())
    assert rows == [("a.py", "LOG-003", 7)] or rows[0] == ("a.py", "LOG-003", 7)


def test_whole_scan_of_a_directory(spark, tree):
    result = scan(S.read_directory(spark, str(tree), "demo"), built_in_catalog(spark), SMALL)
    total = result.summary().head()
    assert (total.repo, total.files_scanned, total.skipped_files) == ("demo", 3, 2)


def test_unscanned(spark):
    files = spark.createDataFrame([("h1",), ("h2",)], "file_hash string")
    seen = spark.createDataFrame([("h1",), ("h1",)], "file_hash string")
    assert [r.file_hash for r in S.unscanned(files, seen).collect()] == ["h2"]


def test_links_and_unreadable_files(spark, tmp_path):
    root, other = tmp_path / "root", tmp_path / "other"
    (root / "sub").mkdir(parents=True)
    other.mkdir()
    (root / "a.py").write_text("x = 1\n")
    (root / "sub" / "b.py").write_text("y = 2\n")
    (other / "c.py").write_text("z = 3\n")
    (root / "sub" / "up").symlink_to(root)
    (root / "far").symlink_to(other)
    (root / "out.py").symlink_to(other / "c.py")
    (root / "in.py").symlink_to(root / "a.py")
    (root / "gone.py").symlink_to(root / "missing.py")
    raw = S.read_directory(spark, str(root), "r")
    rows = {r.path: (r.length, r.content) for r in raw.collect()}
    assert set(rows) - {"gone.py"} == {"a.py", "in.py", "out.py", "sub/b.py"}
    assert rows["out.py"] == (-1, None) and bytes(rows["in.py"][1]) == b"x = 1\n"
    odd = spark.createDataFrame([("r", "q.py", 5, None)], "repo string, path string, length bigint, content binary")
    reasons = {r.path: r.skip_reason for r in S.file_quality(raw.unionByName(odd)).collect()}
    assert reasons["out.py"] == "outside" and reasons["q.py"] == "unreadable" and reasons["a.py"] is None


def test_a_large_tree_is_listed_in_rounds(spark, tmp_path, monkeypatch):
    """A flat folder, a deep chain and many small folders: the same files as a walk on one machine finds."""
    flat, chain = tmp_path / "flat", tmp_path
    flat.mkdir()
    for k in range(2500):
        (flat / f"f{k}.py").touch()
    for k in range(40):
        chain = chain / f"d{k}"
        chain.mkdir()
        (chain / "x.java").write_text("int x;\n")
    for k in range(60):
        (tmp_path / f"many/m{k}/node_modules").mkdir(parents=True)
        for j in range(50):
            (tmp_path / f"many/m{k}/f{j}.py").touch()
        (tmp_path / f"many/m{k}/node_modules/no.py").touch()
    got = sorted(r["path"] for r in S.read_directory(spark, str(tmp_path), "r").select("path").collect())
    want = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.suffix in (".py", ".java") and "node_modules" not in p.parts)
    assert got == want and len(got) == 2500 + 40 + 3000
    # One walk stops after so many entries and leaves its open directories to the next round.
    monkeypatch.setattr(S, "_WALKED", 100)
    fs, base = S._open(str(tmp_path))
    one = list(S._walked(fs, base, True, base, lambda path: False, lambda path: path.endswith(".py")))
    rows = [tuple(r) for frame in one for r in frame.itertuples(index=False)]
    assert any(is_directory for _, is_directory, _ in rows) and len(rows) < 3000
