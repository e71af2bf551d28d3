"""Source files that do not parse, and documented functions of those that do."""

from __future__ import annotations

import symtable
import warnings
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.docpairs import grammar_functions, python_functions, substantive
from graphmill.llm.grammar import Verdict, language

#: Languages that are checked, and those that have functions.
CHECKED = ["python", "java", "typescript", "javascript", "kotlin", "bpmn"]
WITH_FUNCTIONS = ["python", "java", "typescript", "javascript", "kotlin"]


def text_of(content: bytes) -> str:
    """UTF-8 text without a byte-order mark; raises on other bytes."""
    return content.decode("utf-8").removeprefix("﻿")


def _parses_python(text: str) -> None:
    """Raise if a text is not Python; the symbol table needs the whole parse and refuses repeated arguments too."""
    symtable.symtable(text, "<file>", "exec")


def check_file(content: bytes, lang: str, where: bool = True) -> Verdict:
    """Verdict on one file; an empty file is legal in every language."""
    try:
        text = text_of(content)
    except UnicodeDecodeError as e:
        return Verdict(False, content[: e.start].count(b"\n") + 1, "not UTF-8")
    if not text.strip():
        return Verdict(True)
    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                _parses_python(text)
        except SyntaxError as e:
            return Verdict(False, e.lineno or 0, e.msg)
        except (ValueError, RecursionError, MemoryError) as e:
            return Verdict(False, 0, str(e))
        return Verdict(True)
    if lang == "bpmn":
        p = expat.ParserCreate(namespace_separator=" ")
        try:
            p.Parse(content, True)
        except expat.ExpatError as e:
            return Verdict(False, e.lineno, str(e))
        return Verdict(True)
    return language(lang).check(text, where)


def invalid_files(files: DataFrame, where: bool = True) -> DataFrame:
    """``(file_id, service, language, file_path, line, reason)`` of files that are not valid in their language.

    Null content, null or other languages are no case. Repeated rows come out as often as they occur.
    Columns other than those named never reach the worker. ``where=False`` leaves ``line`` at 0 for
    files of the bundled grammars and saves the search for it.
    """
    src = files.where(F.col("language").isin(CHECKED) & F.col("content").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"), "service", "language", "file_path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lines, why = [], [], []
            for i, (lang, c) in enumerate(zip(b.column(2).to_pylist(), b.column(4).to_pylist())):
                v = check_file(c, lang, where)
                if not v.ok:
                    rows.append(i)
                    lines.append(v.line)
                    why.append(v.reason)
            if rows:
                kept = [b.column(k).take(pa.array(rows)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(lines, pa.int32()), pa.array(why, pa.string())], names=["file_id", "service", "language", "file_path", "line", "reason"])

    return src.mapInArrow(run, "file_id bigint, service string, language string, file_path string, line int, reason string")


def documented_functions(files: DataFrame, least_words: int = 4) -> DataFrame:
    """``(file_id, service, language, qualified_name, line_start, line_end, signature, documentation, code)``.

    Functions and methods of valid files with documentation of substance. A file without content, in
    another language or not valid has none. Overloads with documentation come out one row each.
    """
    src = files.where(F.col("language").isin(WITH_FUNCTIONS) & F.col("content").isNotNull()).select(F.col("file_id").cast("bigint").alias("file_id"), "service", "language", F.coalesce("file_path", F.lit("")).alias("file_path"), "content")
    names = ["file_id", "service", "language", "qualified_name", "line_start", "line_end", "signature", "documentation", "code"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for fid, service, lang, path, c in zip(*(b.column(k).to_pylist() for k in range(5))):
                if lang != "python" and b"/**" not in c:
                    continue
                try:
                    text = text_of(c)
                except UnicodeDecodeError:
                    continue
                found = python_functions(text) if lang == "python" else grammar_functions(text, lang)
                good = [f for f in found or () if f.doc and substantive(f.doc, f.name, least_words)]
                if not good or lang != "python" and not language(lang).check(text, False).ok:
                    continue
                lines = text.splitlines()
                for f in good:
                    for col, v in zip(out, (fid, service, lang, f.qualified(path), f.line_start, f.line_end, f.signature, f.doc, "\n".join(lines[f.line_start - 1 : f.line_end]))):
                        col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return src.mapInArrow(run, "file_id bigint, service string, language string, qualified_name string, line_start int, line_end int, signature string, documentation string, code string")
