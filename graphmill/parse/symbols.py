"""Symbols of source files as a table function.

Python files are parsed to syntax trees, BPMN files as XML, interface-definition and GraphQL files by
small block readers. Other languages need a grammar: see ``llm/filesymbols.py``.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = [("kind", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("signature", pa.string()), ("docstring", pa.string()), ("is_method", pa.bool_()), ("parent_class", pa.string())]
DDL = "kind string, name string, qualified_name string, line_start int, line_end int, signature string, docstring string, is_method boolean, parent_class string"


def _symbol(path, kind, name, a, b, sig, doc, parent=None):
    q = f"{path}::{parent}.{name}" if parent else f"{path}::{name}"
    return (kind, name, q, a, b, sig, doc or None, kind == "function" and parent is not None, f"{path}::{parent}" if parent else None)


def python_symbols(path: str, text: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    out: list[tuple] = []

    def walk(node, parent):
        for c in ast.iter_child_nodes(node):
            if isinstance(c, ast.ClassDef):
                out.append(_symbol(path, "class", c.name, c.lineno, c.end_lineno, f"class {c.name}", ast.get_docstring(c)))
                walk(c, c.name)
            elif isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(_symbol(path, "function", c.name, c.lineno, c.end_lineno, f"def {c.name}({ast.unparse(c.args)})", ast.get_docstring(c), parent))
                walk(c, None)
            elif isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                walk(c, parent)

    walk(tree, None)
    return out


def bpmn_symbols(path: str, text: str) -> list[tuple]:
    """A process is a class, its tasks, events and gateways are methods."""
    root = ElementTree.fromstring(text)
    lines = text.splitlines()

    def line_of(ident: str) -> int:
        return next((i + 1 for i, x in enumerate(lines) if f'"{ident}"' in x), 1)

    out: list[tuple] = []
    for p in root.iter():
        if p.tag.rpartition("}")[2] != "process":
            continue
        name = p.get("name") or p.get("id") or "process"
        out.append(_symbol(path, "class", name, line_of(p.get("id") or name), line_of(p.get("id") or name), f"process {name}", None))
        for e in p.iter():
            tag = e.tag.rpartition("}")[2]
            if tag.endswith(("Task", "Event", "Gateway")) or tag == "task":
                own = e.get("name") or e.get("id") or tag
                at = line_of(e.get("id") or own)
                out.append(_symbol(path, "function", own, at, at, f"{tag} {own}", None, name))
    return out


def _blank_comments(text: str) -> str:
    return re.sub(r"/\*.*?\*/|//[^\n]*|#[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _blocks(text: str, opener: str) -> Iterator[tuple[re.Match, int, int]]:
    """(header, start and end of the body) of each brace block whose header matches."""
    for m in re.finditer(opener, text):
        depth, i = 1, m.end()
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        yield m, m.end(), i - 1


def avdl_symbols(path: str, text: str) -> list[tuple]:
    """Protocols, records, enums and errors are classes; messages and fields are their members."""
    clean, out = _blank_comments(text), []
    at = lambda i: text.count("\n", 0, i) + 1
    for m, a, b in _blocks(clean, r"\b(protocol|record|error|enum)\s+(\w+)\s*\{"):
        out.append(_symbol(path, "class", m[2], at(m.start()), at(b), f"{m[1]} {m[2]}", None))
        if m[1] == "enum":
            continue
        depth, start = 0, a
        for i in range(a, b):
            depth += {"{": 1, "}": -1}.get(clean[i], 0)
            if clean[i] == "}" and depth == 0:
                start = i + 1
            if clean[i] == ";" and depth == 0:
                s = clean[start:i].strip()
                start = i + 1
                call = re.search(r"(\w+)\s*\(", re.sub(r"@\w+\([^)]*\)", "", s)) if m[1] == "protocol" else None
                plain = re.search(r"(\w+)\s*(?:=.*)?$", s, re.S) if m[1] != "protocol" else None
                if name := (call or plain):
                    out.append(_symbol(path, "function", name[1], at(i), at(i), " ".join(s.split()), None, m[2]))
    return out


def graphql_symbols(path: str, text: str) -> list[tuple]:
    """Types are classes, their fields are members."""
    clean, out = re.sub(r"#[^\n]*", "", text), []
    at = lambda i: text.count("\n", 0, min(i, len(text))) + 1
    for m, a, b in _blocks(clean, r"\b(type|interface|input|enum)\s+(\w+)[^{}]*\{"):
        out.append(_symbol(path, "class", m[2], at(m.start()), at(b), f"{m[1]} {m[2]}", None))
        body = re.sub(r"\([^)]*\)", "", clean[a:b])
        for f in re.finditer(r"^\s*(\w+)\s*:", body, re.M):
            out.append(_symbol(path, "function", f[1], at(a), at(b), f[1], None, m[2]))
    return out


PARSERS = {"python": python_symbols, "bpmn": bpmn_symbols, "avdl": avdl_symbols, "graphql": graphql_symbols}


def parse_symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files(file_id, file_path, language, content)``; broken files yield none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for fid, path, lang, content in zip(*(b.column(k).to_pylist() for k in range(4))):
                try:
                    found = PARSERS[lang](path, content.decode("utf-8").removeprefix("﻿"))
                except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError, ElementTree.ParseError):
                    continue
                ids += [fid] * len(found)
                rows += found
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(FIELDS)]], names=["file_id", *[n for n, _ in FIELDS]])

    src = files.where(F.col("language").isin(list(PARSERS)) & F.col("content").isNotNull())
    return src.select(F.col("file_id").cast("bigint").alias("file_id"), F.coalesce("file_path", F.lit("")).alias("file_path"), "language", "content").mapInArrow(run, f"file_id bigint, {DDL}")
