"""Source files that do not parse.

The language is that which the path's suffix claims. A file's statements are
parsed by recursive descent, its expressions by precedence climbing; after an
error the parser skips to where the next statement can begin (panic mode) and
goes on, so all errors are stored, the first being the cause. Texts that nest
deeper than the usual stack are parsed again in a thread with a larger one.
"""

from __future__ import annotations

import sys
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.grammar.c import C
from quern.llm.grammar.go import Go
from quern.llm.grammar.java import Java
from quern.llm.grammar.js import Js, Ts
from quern.llm.grammar.json import Json
from quern.llm.grammar.php import Php
from quern.llm.grammar.python import Python
from quern.llm.languages import suffix
from quern.session import spread

PARSERS = {".py": ("Python", Python), ".js": ("JavaScript", Js), ".ts": ("TypeScript", Ts), ".java": ("Java", Java), ".c": ("C", C), ".h": ("C", C), ".go": ("Go", Go), ".php": ("PHP", Php), ".json": ("JSON", Json)}
PARSED = "repo_name string, file_path string, language string, errors array<struct<line: int, wanted: string>>"
DEPTH = 6_000
#: For the texts that nest deeper: Python frames for each character, more than any grammar takes, and bytes of the thread's stack, touched only as far as it is used.
FRAMES, STACK = 60, 512_000_000


def deeper(parser: type, text: str):
    """The parser and its errors with room for all nesting that a text of this length can hold; None if memory ends."""
    out = []

    def run():
        try:
            p = parser(text)
            out.append((p, p.parse()))
        except MemoryError:
            pass

    held, size = sys.getrecursionlimit(), threading.stack_size(STACK)
    sys.setrecursionlimit(min(2**31 - 1, DEPTH + FRAMES * len(text)))
    try:
        t = threading.Thread(target=run)
        t.start()
        t.join()
    finally:
        sys.setrecursionlimit(held)
        threading.stack_size(size)
    return out[0] if out else None


def errors_of(text: str, suffix_: str) -> list[tuple[int, str]]:
    """(line, what was wanted) of all errors of ``text`` as a file with this suffix."""
    parser = PARSERS[suffix_][1]
    p = parser(text)
    errors = p.parse()
    if any(wanted == "less nesting" for _, wanted in errors):
        p, errors = deeper(parser, text) or (p, errors)
    return p.lines(errors) if errors else []


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = sys.getrecursionlimit()
    sys.setrecursionlimit(max(held, DEPTH))
    kind = pa.list_(pa.struct([("line", pa.int32()), ("wanted", pa.string())]))
    try:
        for b in batches:
            errors = [[{"line": line, "wanted": w} for line, w in errors_of(t, s)] for s, t in zip(b.column("suffix").to_pylist(), b.column("content").to_pylist())]
            languages = [PARSERS[s][0] for s in b.column("suffix").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("repo_name"), b.column("file_path"), pa.array(languages, pa.string()), pa.array(errors, kind)], ["repo_name", "file_path", "language", "errors"])
    finally:
        sys.setrecursionlimit(held)


def parsed(files: DataFrame) -> DataFrame:
    """repo_name, file_path, language and errors (line, wanted) of every text file of the nine suffixes.

    Files with null content, other suffixes, no suffix or a null path are left
    out; an empty text is a valid program, but no valid JSON or Go. Repeated
    rows are parsed and returned as often as they stand. Nesting counts as an
    error only where a worker's memory can't hold it.
    """
    rows = files.where((F.col("content_type") == "text") & F.col("content").isNotNull()).select("repo_name", "file_path", suffix().alias("suffix"), "content")
    return spread(rows.where(F.col("suffix").isin(list(PARSERS)))).mapInArrow(_parse, PARSED)


def invalid(files: DataFrame) -> DataFrame:
    """The files with errors: n_errors and, as the first cause, first_line and first_wanted."""
    bad = parsed(files).where(F.size("errors") > 0)
    return bad.select("repo_name", "file_path", "language", F.size("errors").alias("n_errors"), F.col("errors")[0]["line"].alias("first_line"), F.col("errors")[0]["wanted"].alias("first_wanted"), "errors").dropDuplicates(["repo_name", "file_path", "first_line", "first_wanted", "n_errors"])


def rates(files: DataFrame) -> DataFrame:
    """Per repo_name and language, and with a null repo_name over all of them: files, invalid_files, rate. Repeated rows count once."""
    one = parsed(files).groupBy("repo_name", "file_path", "language").agg(F.max((F.size("errors") > 0).cast("int")).alias("bad"))
    by = one.groupBy("repo_name", "language").agg(F.count("*").alias("files"), F.sum("bad").alias("invalid_files"))
    by = by.unionByName(by.groupBy("language").agg(F.sum("files").alias("files"), F.sum("invalid_files").alias("invalid_files")).withColumn("repo_name", F.lit(None).cast("string")))
    return by.withColumn("rate", F.col("invalid_files") / F.col("files"))
