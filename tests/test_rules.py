"""Findings on small written-out files: the sets of rule and line are fixed."""

from siftspark.functions import patterns as P
from siftspark.operators import extract, findings
from siftspark.operators.rules import Rule
from siftspark.options import ScanOptions

PY_SAMPLE = """from app.audit import logger as audit


class Importer:
    def load_rows(self, source):
        total = 0
        for row in source:
            try:
                total += int(row["amount"])
            except ValueError:
                continue
            except Exception:
                pass
        return total

    def open_session(self, user, api_key):
        audit.debug("opening session with api_key=%s", api_key)
        return Session(user)

    def reply(self, job):
        try:
            return job.result()
        except TimeoutError as late:
            audit.error("job late", exc_info=late)
            return {"detail": str(late)}

    def trace(self, request):
        audit.info("headers were %s", request.headers)
"""
JAVA_SAMPLE = """package shop.stock;

class StockReader {
    private final Queue<Order> waiting = new Queue<>();

    int countOpen(Warehouse warehouse) {
        int open = 0;
        try {
            open = warehouse.fetch().size();
        } catch (IOException broken) {
            System.out.println("fetch went wrong " + broken);
        }
        return open;
    }

    Response refund(Order order, String password) {
        logger.info("refund with password " + password);
        try {
            ledger.book(order);
        } catch (LedgerException e) {
            logger.error("refund failed");
            return Response.status(500).entity(e.getMessage()).build();
        }
        return Response.ok().build();
    }
}
"""


def found(frame):
    return sorted((r.rule_id, r.line) for r in frame.collect())


def scan(files, mode):
    return findings.raw_findings(files, ScanOptions(block_mode=mode))


def test_python_sample_scoped(make_files):
    assert found(scan(make_files(("a.py", PY_SAMPLE)), "scoped")) == [
        ("ERR-003", 10), ("ERR-003", 12), ("LOG-003", 17), ("LOG-004", 28)]


def test_python_sample_window(make_files):
    assert found(scan(make_files(("a.py", PY_SAMPLE)), "window")) == [
        ("LOG-003", 17), ("LOG-004", 28)]


def test_java_sample_scoped(make_files):
    assert found(scan(make_files(("A.java", JAVA_SAMPLE)), "scoped")) == [
        ("ERR-001", 20), ("ERR-002", 20), ("ERR-002", 22), ("LOG-003", 17), ("LOG-005", 10),
        ("LOG-005", 11)]


def test_java_sample_window(make_files):
    assert found(scan(make_files(("A.java", JAVA_SAMPLE)), "window")) == [
        ("ERR-001", 10), ("ERR-001", 20), ("ERR-002", 10), ("ERR-002", 20), ("ERR-002", 22),
        ("LOG-003", 17), ("LOG-005", 10), ("LOG-005", 11)]


def test_clean_files(make_files):
    files = make_files(
        ("ok.py", 'logger.warning("login failed", extra={"username": username})\n'),
        ("Ok.java", 'class Ok {\n  void a() { logger.warn("login failed for {}", username); }\n}\n'))
    assert found(scan(files, "scoped")) == []
    assert found(scan(files, "window")) == []


def test_console_calls_are_reported_for_java_only(make_files):
    body = "try {\n} catch (E ex) {\n  System.out.println(\"x\" + y);\n  throw ex;\n}\n"
    assert found(scan(make_files(("A.java", body)), "scoped")) == [("LOG-005", 2), ("LOG-005", 3)]
    assert found(scan(make_files(("a.py", "print('x')\n")), "scoped")) == []


def test_one_line_catch_keeps_the_console_row(make_files):
    files = make_files(("A.java", "x\n} catch (E e) { e.printStackTrace(); }\n"))
    rows = [r for r in scan(files, "scoped").collect() if r.rule_id == "LOG-005"]
    assert [(r.line, list(r.signals)) for r in rows] == [(2, ["console_logging"])]


def test_comment_lines_are_skipped_by_line_rules(make_files):
    text = "# logger.info(password)\n// logger.info(password)\n  * logger.info(password)\n"
    assert found(scan(make_files(("a.py", text)), "window")) == []


def test_disable_and_response_lines(make_files):
    text = 'logging.disable(50)\nreturn str( exc )\nlevel = "OFF"\n'
    assert found(scan(make_files(("a.py", text)), "window")) == [
        ("ERR-002", 2), ("LOG-007", 1), ("LOG-007", 3)]


def test_case_folding_outside_ascii(make_files):
    # The long s folds to s, the dotless i to i; a byte search alone would not see it.
    text = "logg\u0131ng.disable(1)\nx.d\u0131\u017fabled = True\n"
    assert found(scan(make_files(("a.py", text)), "window")) == [("LOG-007", 1), ("LOG-007", 2)]


def test_scoped_clauses(make_files):
    java = ("a\n  } catch (A e) { if (x) { y(); } } finally { z(); }\n"
            "  try { a(); } catch(B e) {\n    b();\n  }\n")
    rows = extract.exception_blocks(make_files(("A.java", java)), "scoped").collect()
    assert [(r.start_line, r.end_line, r.text) for r in rows] == [
        (2, 2, "catch (A e) { if (x) { y(); } }"), (3, 5, "catch(B e) {\n    b();\n  }")]
    python = "try:\n    a()\nexcept(A, B):\n    b()\n\n    # end\nelse:\n    c()\n"
    rows = extract.exception_blocks(make_files(("a.py", python)), "scoped").collect()
    assert [(r.start_line, r.end_line, r.text) for r in rows] == [(3, 4, "except(A, B):\n    b()")]


def test_scoped_falls_back_to_windows(make_files):
    rows = extract.exception_blocks(make_files(("a.py", "} catch (E e) {\n  x\n")), "scoped")
    assert [(r.kind, r.start_line, r.end_line) for r in rows.collect()] == [("catch", 1, 2)]


def test_repeats_go_wherever_they_stand(make_files):
    text = "\n".join(["logger.info(password)", "x = 1"] * 4)
    assert found(scan(make_files(("a.py", text)), "window")) == [("LOG-003", k) for k in (1, 3, 5, 7)]


def test_custom_rule(make_files):
    todo = Rule("LOG-006", "line", (P.Pattern("todo", "TODO", needs=("todo",)),), (),
                "Left to do.", 0.5, ("todo",))
    options = ScanOptions(custom_rules=(todo,))
    rows = findings.findings(make_files(("a.py", "x\n# todo later\n")), options).collect()
    assert [(r.rule_id, r.line, r.evidence) for r in rows] == [("LOG-006", 2, "# todo later")]


def test_extractors_python(make_files):
    text = ("import logging\nfrom web import App\napp = App()\n\n@app.exception_handler(Exception)\n"
            "def on_error(request, exc):\n    logging.error(str(exc))\n    return {'e': 'x'}\n\n"
            "@app.get('/in')\ndef enter(request):\n    try:\n        go()\n"
            "    except Exception:\n        print('failed')\n")
    files = make_files(("a.py", text))
    syms = {(r.name, r.kind, r.start_line, r.end_line) for r in extract.symbols(files).collect()}
    assert ("on_error", "function", 6, 9) in syms and ("enter", "function", 11, 15) in syms
    assert [r.text for r in extract.imports(files).collect()] == [
        "import logging", "from web import App"]
    assert [(r.line, r.symbol) for r in extract.logger_calls(files).collect()] == [(7, "on_error")]
    assert [(r.line, r.symbol) for r in extract.console_calls(files).collect()] == [(15, "enter")]
    block = extract.exception_blocks(files, "window").collect()[0]
    assert (block.kind, block.start_line, block.end_line, block.symbol) == (
        "exception", 14, 15, "enter")
    assert [r.start_line for r in extract.api_handlers(files).collect()] == [10]
    assert [r.start_line for r in extract.global_handlers(files).collect()] == [5]


def test_long_prose_line_does_not_exhaust_the_stack(make_files):
    line = "word " * 60_000 + "name(x) {"
    rows = extract.symbols(make_files(("A.java", line))).collect()
    assert [(r.name, r.start_line) for r in rows] == [("name", 1)]
