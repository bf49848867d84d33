"""Ends of symbols and clauses, and symbols around lines, against their plain definitions."""

import random
import time

import pytest

from siftspark.functions import patterns as P
from siftspark.operators import extract, snippets
from siftspark.options import ScanOptions

LINES = (
    "class Pa(object):", "def pb(x):", "    def pc(self):", "        def pd(self):", "  def pe(a):", "# note", "", "    ",
    "x = 1", "    y = 2", "        logger.info(token)", "            z = {", "}", "    }", "        } }", "{ {", "{", "} {",
    "public class Ja {", "    public int jb(int a) {", "    int jc(int a)", "  void jd(String s) { run(); }", "log.warn(password);",
    "  } catch (Exception e) {", "} catch (A a) { x(); }", "  catch (B b)", "  } catch (C c) { if (y) { z(); }",
    "    except ValueError:", "  except:", "        except (A, B) as e:", "    pass", "    return 1",
)


def indent(line):
    return len(line) - len(line.lstrip())


def indent_stop(lines, at):
    """Place of the first later line that is not blank, no comment and not deeper."""
    return next((j for j in range(at + 1, len(lines))
                 if lines[j].strip() and not lines[j].strip().startswith("#") and indent(lines[j]) <= indent(lines[at])), None)


def delta(text):
    return text.count("{") - text.count("}")


def symbol_end(lines, at, braces):
    if not braces:
        stop = indent_stop(lines, at)
        return len(lines) if stop is None else stop
    target = delta("".join(lines[:at]))
    opened = next((j for j in range(at, len(lines)) if "{" in lines[j]), None)
    if opened is not None:
        for j in range(opened, len(lines)):
            if ("{" in lines[j] or "}" in lines[j]) and delta("".join(lines[:j + 1])) <= target:
                return j + 1
    return min(at + 1 + 20, len(lines))


def java_clause(lines, at):
    line = lines[at]
    rest = "\n".join([line[line.index("catch"):], *lines[at + 1:]])
    depth, seen = 0, False
    for k, char in enumerate(rest):
        if char == "{":
            depth, seen = depth + 1, True
        elif char == "}":
            depth -= 1
            if seen and depth <= 0:
                return rest[:k + 1]
    return "\n".join([line[line.index("catch"):], *lines[at + 1:at + 21]])


def python_clause(lines, at):
    stop = indent_stop(lines, at)
    last = len(lines) if stop is None else stop
    while not lines[last - 1].strip() or lines[last - 1].strip().startswith("#"):
        last -= 1
    return last, "\n".join(lines[at:last]).lstrip()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    files = []
    for k in range(60):
        lines = [rng.choice(LINES) for _ in range(rng.randrange(1, 70))]
        files.append((f"d{k}.{'py' if k % 2 else 'java'}", [*lines, "end"]))
    # More lines than one chunk of a pass holds.
    files.append(("long.java", [rng.choice(LINES) for _ in range(1500)] + ["end"]))
    files.append(("deep.py", [" " * k + f"def p{k}():" for k in range(120)] + ["end"]))
    return dict(files)


@pytest.fixture(scope="module")
def frame(make_files, corpus):
    return make_files(*[(path, "\n".join(lines)) for path, lines in corpus.items()]).cache()


@pytest.fixture(scope="module")
def symbols(frame):
    found = {}
    for r in extract.symbols(frame).collect():
        found.setdefault(r["path"], []).append((r["start_line"], r["end_line"], r["name"]))
    return found


def test_symbol_ends(corpus, symbols):
    checked = 0
    for path, found in symbols.items():
        lines = corpus[path]
        for start, end, name in found:
            assert end == symbol_end(lines, start - 1, name.lower().startswith("j")), (path, start, name)
            checked += 1
    assert checked > 300


def test_innermost_symbol(frame, symbols):
    calls = extract.logger_calls(frame).collect()
    for r in calls:
        around = [(s, n) for s, e, n in symbols.get(r["path"], []) if s <= r["line"] <= e]
        assert r["symbol"] == (max(around)[1] if around else None), (r["path"], r["line"])
    assert sum(r["symbol"] is not None for r in calls) > 50


def test_clauses(corpus, frame):
    got = {}
    for r in extract.exception_blocks(frame, "scoped").collect():
        got.setdefault(r["path"], []).append((r["start_line"], r["end_line"], r["text"]))
    for path, lines in corpus.items():
        want = []
        for at, line in enumerate(lines):
            if path.endswith(".py") and line.lstrip().startswith("except"):
                last, text = python_clause(lines, at)
                want.append((at + 1, last, text))
            if path.endswith(".java") and "catch (" in line:
                text = java_clause(lines, at)
                want.append((at + 1, at + 1 + text.count("\n"), text))
        if want:
            assert sorted(got[path]) == want, path


def test_hot_symbols(corpus, frame, symbols):
    """Symbols that hold a hot word in any of their lines, and no others."""
    got = {(r["path"], r["start_line"], r["end_line"]) for r in snippets.hotspots(frame, ScanOptions()).collect()}
    for path, found in symbols.items():
        lines = corpus[path]
        for start, end, name in found:
            if path.endswith(".java") and name in ("Pa", "pb", "pc", "pd", "pe", "Ja"):
                continue
            hot = any(w in line.lower() for line in lines[start - 1:end] for w in P.HOTWORDS)
            assert ((path, start, end) in got) == hot or any(s == start for p, s, e in got if p == path and e != end)


def methods(n, language):
    if language == "python":
        return "class A:\n" + "\n".join(f"    def m{k}(self):\n        logger.info(token)\n        return {k}" for k in range(n))
    return "class A {\n" + "\n".join(f"  public int m{k}(int a) {{\n    log.info(token);\n    return a; }}" for k in range(n)) + "\n}"


@pytest.mark.parametrize(("name", "language"), [("a.py", "python"), ("a.java", "java")])
def test_time_grows_with_the_file(make_files, name, language):
    def seconds(n):
        files = make_files((name, methods(n, language)))
        started = time.time()
        rows = extract.logger_calls(files).collect()
        assert len(rows) == n and all(r["symbol"].startswith("m") for r in rows)
        return time.time() - started
    seconds(500)
    one, two = seconds(4000), seconds(8000)
    assert two <= 2.5 * one + 1
