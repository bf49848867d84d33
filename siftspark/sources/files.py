"""Corpus sources: raw files to accepted code files, with a ledger of the ones left out.

A corpus is any table of (repo, path, length, content): a directory read by tasks, or a table landed
once. Every test is an expression over one row, so selecting files shuffles nothing; only a
file limit needs an order, and that is taken over paths without their content.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.functions.sql import any_of, either, let, lit, strings
from siftspark.functions.text import rlike
from siftspark.options import SUFFIXES, ScanOptions
from siftspark.sources.landing import landed

# The bounds of the content tests.
BINARY_PROBE_BYTES = 4096
MINIFIED_BYTES = 20_000
MINIFIED_LINE = 1000


def read_directory(spark: SparkSession, root: str, repo: str | None = None,
                   options: ScanOptions = ScanOptions(),
                   globs: tuple[str, ...] | None = None) -> DataFrame:
    """raw(repo, path, length, content) of a directory tree or a single file.

    Linked directories are not entered; a linked file that leads out of the root has length -1 and, like a
    file that cannot be read, no content: both get a row in the skip ledger.

    Spark's own file readers leave out every name that starts with ``_`` or ``.``, and with them
    each ``__init__.py``. So tasks list and read here, in rounds: each task walks below the directories it
    got until it has met ``_WALKED`` entries; directories still open are dealt out anew in the next round.
    What is found is a table, never a list on the driver. Ignored directories are not entered, ignored
    files and the content of oversized ones are not read.
    """
    system, base = _open(root)
    single = system.get_file_info(base).type == pafs.FileType.File
    top = base.rsplit("/", 1)[0] if single else base
    chosen = load_ignores(spark, root, options) if globs is None else globs
    prune = _directory_filter(chosen)
    wanted = _suffix_test(options)
    limit = options.max_file_bytes

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _open(root)
        for batch in batches:
            for start, is_directory in zip(batch["entry"], batch["is_directory"]):
                yield from _walked(fs, start, is_directory, top, prune, wanted)

    kind = "entry string, is_directory boolean, length bigint"
    frontier = spark.createDataFrame([(base, not single)], "entry string, is_directory boolean")
    found = None
    while frontier is not None:
        level = landed(frontier.repartition("entry").mapInPandas(walk, kind), "listing")
        files = level.where("NOT is_directory").selectExpr("entry AS file", "length")
        found = files if found is None else found.unionByName(files)
        deeper = level.where("is_directory").select("entry", "is_directory")
        frontier = None if deeper.isEmpty() else deeper

    def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = _open(root)
        for batch in batches:
            rows, held = [], 0
            for file, length in zip(batch["file"], batch["length"]):
                content = None
                if 0 <= length <= limit:
                    try:
                        with fs.open_input_stream(file) as source:
                            content = source.read()
                        held += len(content)
                    except OSError:  # gone or not readable: a row of the ledger, not the end of the scan
                        content = None
                rows.append((file[len(top):].lstrip("/"), length, content))
                if held > _READ_BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "length", "content"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "length", "content"])

    below = found.withColumn("path", F.expr(f"ltrim('/', substring(file, {len(top) + 1}))"))
    content = ignore_filter(below, chosen).select("file", "length").repartition(
        "file").mapInPandas(read_files, "path string, length bigint, content binary")
    return content.selectExpr(f"{lit(repo or top)} AS repo", "path", "length", "content")


def _suffix_test(options: ScanOptions) -> Callable[[str], bool]:
    suffixes = tuple(s for s, _ in options.suffixes)
    return lambda path: path.lower().endswith(suffixes)


_READ_BATCH_BYTES = 32 << 20
_WALKED = 2_000      # entries that one start of a walk meets before its open directories are dealt out


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        system, path = pafs.FileSystem.from_uri(root)
    else:
        system, path = pafs.LocalFileSystem(), os.path.abspath(root)
    return system, path.rstrip("/") or "/"


def _directory_filter(globs: tuple[str, ...]) -> Callable[[str], bool]:
    """Whether a directory, as a path below the root, is covered by a pattern."""
    # An empty expression stands for no pattern of its kind.
    tests = [re.compile(e or "(?!)") for e in _ignore_expressions(globs)]

    def covered(path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        subjects = ("/" + path + "/", path + "/", name)
        return any(t.search(s) for t, s in zip(tests, subjects))
    return covered


def _children(fs: pafs.FileSystem, directory: str) -> list[pafs.FileInfo]:
    """Entries of a directory but linked directories, which may lead in circles; none if it can't be listed."""
    try:
        found = fs.get_file_info(pafs.FileSelector(directory, recursive=False))
    except OSError:
        return []
    local = isinstance(fs, pafs.LocalFileSystem)
    return [i for i in found if not (
        local and i.type == pafs.FileType.Directory and os.path.islink(i.path))]


def _leaves(fs: pafs.FileSystem, path: str, top: str) -> bool:
    """Whether a local file is a link out of the folder that is scanned."""
    if not isinstance(fs, pafs.LocalFileSystem) or not os.path.islink(path):
        return False
    root = os.path.realpath(top)
    return os.path.commonpath([root, os.path.realpath(path)]) != root


def _walked(fs: pafs.FileSystem, start: str, is_directory: bool, top: str, prune: Callable[[str], bool],
            wanted: Callable[[str], bool]) -> Iterator[pd.DataFrame]:
    """Supported files below ``start``, and the directories left open after ``_WALKED`` entries."""
    rows: list[tuple[str, bool, int]] = []
    met = 0
    open_ = [start] if is_directory else []
    infos = [] if is_directory else [fs.get_file_info(start)]
    while open_ or infos:
        for info in infos:
            if info.type == pafs.FileType.File and wanted(info.path):
                rows.append((info.path, False, -1 if _leaves(fs, info.path, top) else info.size))
            elif info.type == pafs.FileType.Directory and not prune(info.path[len(top):].lstrip("/")):
                open_.append(info.path)
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=["entry", "is_directory", "length"])
                rows = []
        met += len(infos)
        if met > _WALKED:
            rows += [(d, True, 0) for d in open_]
            break
        infos = _children(fs, open_.pop()) if open_ else []
    if rows:
        yield pd.DataFrame(rows, columns=["entry", "is_directory", "length"])


def language_of(path: str, suffixes: tuple[tuple[str, str], ...] = SUFFIXES) -> str:
    """Language by lower-case suffix; a name that is only a suffix has none."""
    cases = " ".join(f"WHEN {lit(s)} THEN {lit(n)}" for s, n in suffixes)
    return f"CASE regexp_extract(lower({path}), {lit('[^/]([.][^./]*)$')}, 1) {cases} END"


def language_filter(df: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    wanted = [n for n in options.languages_include if n not in options.languages_exclude]
    names = ", ".join(lit(n) for n in wanted) or "NULL"
    return df.withColumn("language", F.expr(language_of("path", options.suffixes))).where(f"language IN ({names})")


# ----------------------------------------------------------------------------------------- ignores

def glob_body(glob: str) -> str:
    """Regular expression of a shell glob. ``*`` crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        char = glob[i]
        i += 1
        if char == "*":
            out += "" if out.endswith(".*") else ".*"   # a run of stars is one star
        elif char == "?":
            out += "."
        elif char == "[" and "]" in glob[i + 1:]:
            end = glob.index("]", i + 1)
            inside = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + inside[1:] if inside.startswith("!") else inside) + "]"
            i = end + 1
        else:
            out += _literal(char)
    return out


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", text)


def _ignore_expressions(globs: tuple[str, ...]) -> tuple[str, str, str]:
    """Expressions for a path after a slash, for a path as it is, and for a base name."""
    globs = tuple(g for g in (g.replace("\\", "/").strip() for g in globs) if g)
    # A pattern is tried on the path and on the path after a slash; the optional slash does both.
    whole = "|".join(glob_body(g) if g.startswith("/") else "/?" + glob_body(g) for g in globs)
    below = "|".join(_literal(g.rstrip("/")) + "/" for g in globs if g.endswith("/"))
    names = "|".join(glob_body(g) for g in globs if "/" not in g)
    return (f"(?s)^(?:{whole})$(?![\\r\\n])" if whole else "", f"(?s)^(?:{below})" if below else "",
            f"(?s)^(?:{names})$(?![\\r\\n])" if names else "")


def ignored(path: str, globs: tuple[str, ...]) -> str:
    """The path, or a directory above it, is covered by a pattern.

    A directory is tested with a slash at its end. All patterns together make three expressions,
    for whole paths, for their beginnings and for base names, however many there are.
    """
    whole, below, names = _ignore_expressions(globs)
    if not whole:
        return "false"

    def hit(s: str) -> str:
        tests = [rlike(f"concat('/', {s})", whole)]
        if below:
            tests.append(rlike(s, below))
        if names:
            tests.append(rlike(f"regexp_extract({s}, {lit('([^/]+)/?$')}, 1)", names))
        return either(tests)

    # The path and each prefix that ends in a slash.
    def subjects(parts: str) -> str:
        above = (f"transform(slice({parts}, 1, size({parts}) - 1), (p, i) ->"
                 f" concat(array_join(slice({parts}, 1, i + 1), '/'), '/'))")
        return any_of(f"array_append({above}, {path})", hit)
    return let(f"split({path}, '/', -1)", subjects)


def ignore_filter(df: DataFrame, globs: tuple[str, ...]) -> DataFrame:
    return df.where(f"NOT {ignored('path', globs)}")


def load_ignores(spark: SparkSession, root: str, options: ScanOptions) -> tuple[str, ...]:
    """Default patterns, those of the options, and those of the ignore files at the root."""
    globs = [*options.default_ignores, *options.ignore_patterns]
    system, base = _open(root)
    if system.get_file_info(base).type == pafs.FileType.File:
        base = base.rsplit("/", 1)[0]
    for name in options.ignore_files:      # configuration, not data
        if system.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
            continue
        with system.open_input_stream(f"{base}/{name}") as source:
            text = source.read().decode("utf-8", "replace")
        entries = (line.strip() for line in text.splitlines())
        globs += [entry for entry in entries if entry and not entry.startswith("#")]
    return tuple(globs)


# ------------------------------------------------------------------------------------ file quality

def skip_reason(options: ScanOptions) -> str:
    """Why a supported file is left out, or null. The first reason that applies counts."""
    sample = f"decode(substring(content, 1, {MINIFIED_BYTES}), 'ISO-8859-1')"
    long_line = any_of(f"split({sample}, {lit('[' + chr(92) + 'r' + chr(92) + 'n]')}, -1)",
                       lambda x: f"length({x}) > {MINIFIED_LINE}")
    return (
        "CASE WHEN length < 0 THEN 'outside'"
        f" WHEN length > {options.max_file_bytes} THEN 'size'"
        " WHEN content IS NULL THEN 'unreadable'"
        f" WHEN contains(substring(content, 1, {BINARY_PROBE_BYTES}), X'00') THEN 'binary'"
        f" WHEN length >= {MINIFIED_BYTES} AND {long_line} THEN 'minified' END"
    )


def reason_note(options: ScanOptions) -> str:
    return (
        "concat(path, CASE skip_reason"
        " WHEN 'outside' THEN ': skipped because it leads out of the scanned folder'"
        " WHEN 'unreadable' THEN ': skipped because it could not be read'"
        f" WHEN 'size' THEN ': skipped because size exceeds {options.max_file_bytes} bytes'"
        " WHEN 'binary' THEN ': skipped because it appears to be binary'"
        " WHEN 'minified' THEN ': skipped because it appears to be minified' END)"
    )


def file_quality(raw: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    return raw.withColumn("skip_reason", F.expr(skip_reason(options)))


def supported(raw: DataFrame, options: ScanOptions = ScanOptions(),
              globs: tuple[str, ...] | None = None) -> DataFrame:
    """Raw files that no pattern ignores, in a wanted language."""
    chosen = options.default_ignores + options.ignore_patterns if globs is None else globs
    return ignore_filter(language_filter(raw, options), chosen)


def decode(accepted: DataFrame) -> DataFrame:
    """files(repo, path, language, text, file_hash)."""
    return accepted.selectExpr(
        "repo", "path", "language", "make_valid_utf8(cast(content AS string)) AS text",
        "sha2(content, 256) AS file_hash")


def collect_files(raw: DataFrame, options: ScanOptions = ScanOptions(),
                  globs: tuple[str, ...] | None = None) -> DataFrame:
    """Accepted code files. The size test is a filter of its own, so the scan need not read the
    content of oversized files."""
    small = supported(raw, options, globs).where(f"length <= {options.max_file_bytes}")
    accepted = file_quality(small, options).where("skip_reason IS NULL")
    if options.max_files is not None:
        accepted = accepted.where(_up_to(accepted, options.max_files))
    return decode(accepted)


def _up_to(accepted: DataFrame, limit: int):
    """Files up to the ``limit``-th accepted one in path order; all if there are fewer.

    The cut is found from paths alone, each task keeping its first ones, and returns as one value.
    """
    taken = accepted.select(F.struct("path", "repo").alias("key")).orderBy("key").limit(limit)
    cut = taken.agg(F.when(F.count("*") >= limit, F.max("key")))
    return F.coalesce(F.struct("path", "repo") <= cut.scalar(), F.lit(True))


def skip_ledger(raw: DataFrame, options: ScanOptions = ScanOptions(),
                globs: tuple[str, ...] | None = None) -> DataFrame:
    """(repo, path, reason, note) of supported files left out, and of the file limit."""
    known = supported(raw, options, globs)
    oversized = known.where(f"length > {options.max_file_bytes}").selectExpr(
        "repo", "path", "'size' AS skip_reason")
    unfit = file_quality(known.where(f"length <= {options.max_file_bytes}"), options)
    bad = unfit.where("skip_reason IS NOT NULL").select("repo", "path", "skip_reason")
    ledger = oversized.unionByName(bad)
    if options.max_files is None:
        return ledger.selectExpr("repo", "path", "skip_reason AS reason",
                                 f"{reason_note(options)} AS note")
    accepted = unfit.where("skip_reason IS NULL")
    inside = _up_to(accepted, options.max_files)
    kept = ledger.where(inside).selectExpr("repo", "path", "skip_reason AS reason",
                                           f"{reason_note(options)} AS note")
    # One entry if any supported file follows the last one taken, in the name of the next file.
    after = known.where(~inside).agg(F.min(F.struct("path", "repo")).alias("next"))
    rest = after.where("next IS NOT NULL").selectExpr(
        "next.repo AS repo", "cast(NULL AS string) AS path", "'limit' AS reason",
        f"'File limit reached at {options.max_files}; remaining supported files were skipped.'"
        " AS note")
    return kept.unionByName(rest)


def land(files: DataFrame, table: str, buckets: int) -> None:
    """Write a corpus as a table bucketed by file, so that joins on (repo, path) need no exchange."""
    (files.write.mode("overwrite").bucketBy(buckets, "repo", "path").sortBy("repo", "path")
     .saveAsTable(table))


def unscanned(files: DataFrame, seen_hashes: DataFrame) -> DataFrame:
    """Files whose content hash is not in an earlier scan's table."""
    return files.join(seen_hashes.select("file_hash").distinct(), "file_hash", "left_anti")
