"""A code corpus derived from the ``documents`` table, in Spark and in DuckDB SQL.

Each document becomes one file: every sentence of its whole text becomes a line, some replaced by or
wrapped in a code template chosen by position. The derivation is a map over rows, so the corpus
grows with the table, copies stay copies, and no file holds more than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 96
TEMPLATES = (
    'logger.info("password=%s", password)',
    'logger.info("mask=%s", mask(password))',
    'logger.warning("q=%s", request.args["q"])',
    'logger.warning("q=%s", escape(request.args["q"]))',
    'logging.disable(logging.CRITICAL)',
    '    except Exception as exc:',
    '        pass',
    '        return str(exc)',
    '        raise',
    '        print("failed")',
    '# scan-disable-next-line LOG-003',
    'x = compute(1)',
    'System.out.println("password=" + password);',
    'logger.error(str(exc))',
    '    } catch (Exception e) {',
    '// logger.info(token)',
    'class Job(object):',
    '    def run(self, request):',
    'def handle(request):',
    'public class Service {',
    '    public String load(Request request) {',
    '    }',
    '}',
    'import logging',
    'from app.util import helper',
    '@app.get("/login")',
    '@app.exception_handler(Exception)',
    '    @GetMapping("/item")',
    '# scan-disable-file LOG-007',
    '    log.warn("@@");',
    '    audit("@@", payload)',
    '    e.printStackTrace();',
    '        return ResponseEntity.status(500).body(e.getMessage());',
    '    throw new IllegalStateException("@@");',
    '        logger.exception("failed")',
    '    except ValueError:',
    '',
    '        # @@',
    '    password = "@@"',
    '    Authorization: Bearer abcdefghijklmnop.@@',
    '    url = "postgres://user:pass@db/@@"',
    '    card = 4111 1111 1111 1111',
    '    try { run(); } catch (IOException e) { log.error(e.getMessage()); } finally {',
    '    level = "OFF"',
    '    } catch (SQLException e) { throw e; }',
)
NEUTRAL = '        y = step("@@")'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code_line(doc_id: Column, line: Column, position: Column) -> Column:
    templates = F.array(*[F.lit(t) for t in TEMPLATES])
    slot = (doc_id * 37 + position * 11 + F.length(line) * 5) % SLOTS
    return F.replace(F.coalesce(F.get(templates, slot.cast("int")), F.lit(NEUTRAL)),
                     F.lit("@@"), line)


def as_code(docs: DataFrame) -> DataFrame:
    """files(repo, path, language, text) of documents(doc_id, source, text)."""
    sentences = F.split(F.replace(F.col("text"), F.lit(". "), F.lit(".\n")), "\n", -1)
    text = F.array_join(
        F.transform(sentences, lambda x, i: _code_line(F.col("doc_id"), x, i)), "\n")
    python = F.col("doc_id") % 2 == 0
    return docs.select(
        F.col("source").alias("repo"),
        F.concat(F.lit("svc/d"), F.col("doc_id").cast("string"),
                 F.when(python, ".py").otherwise(".java")).alias("path"),
        F.when(python, "python").otherwise("java").alias("language"),
        text.alias("text"),
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return as_code(docs)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Lines of the same corpus in DuckDB: raw(repo, path, language, line, text), then lines() drops the
# empty last line a trailing break leaves.
CORPUS_SQL = f"""
sentences AS (
  SELECT doc_id, source AS repo,
         'svc/d' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.java' END AS path,
         CASE WHEN doc_id % 2 = 0 THEN 'python' ELSE 'java' END AS language,
         string_split(replace(text, '. ', '.' || chr(10)), chr(10)) AS parts
  FROM documents
),
numbered AS (
  SELECT doc_id, repo, path, language, len(parts) AS n,
         unnest(parts) AS x, generate_subscripts(parts, 1) AS line
  FROM sentences
),
coded AS (
  SELECT repo, path, language, n, line,
         replace(coalesce(
           [{", ".join(_quote(t) for t in TEMPLATES)}]
             [((doc_id * 37 + (line - 1) * 11 + length(x) * 5) % {SLOTS})::INT + 1],
           {_quote(NEUTRAL)}), '@@', x) AS text
  FROM numbered
),
lines AS (
  SELECT repo, path, language, line, text FROM coded WHERE NOT (line = n AND text = '')
)
"""
