"""Classes and functions of Java, TypeScript, JavaScript and Kotlin files, from the bundled grammars' token trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.docpairs import CLASS_WORDS, MODIFIERS, _function_at, _owner, _Tree
from graphmill.llm.grammar import language
from graphmill.llm.sourcefiles import text_of
from graphmill.parse.symbols import DDL, FIELDS, _symbol

LANGUAGES = ["java", "typescript", "javascript", "kotlin"]
#: Words that look like a called or declared name before parentheses, and tokens after which a line goes on.
CONTROL = set("if for while switch catch with return else do try throw new case when await yield typeof super this finally".split())
OPEN_ENDED = set("= ( [ , . ?. ? : && || ?? + - * / % | & => -> return < > == === != !== += -= extends implements".split())


def _declaration(t: _Tree, i: int) -> int:
    """Position after the annotations that open at ``i``."""
    while i + 1 < len(t.text) and t.text[i] == "@" and t.text[i + 1] != "interface":
        i += 2
        while i + 1 < len(t.text) and t.text[i] in (".", ":"):
            i += 2
        if t.text[i : i + 1] == ["("]:
            i = t.close.get(i, i) + 1
        while i < len(t.text) and t.comment(i):
            i += 1
    return i


def _class_at(t: _Tree, i: int, kind: str) -> tuple[str, int] | None:
    """(name, position of the name) of a class declared at ``i``."""
    words = CLASS_WORDS[kind]
    while i + 1 < len(t.text):
        x = t.text[i]
        if x == "@":
            if t.text[i + 1] != "interface":
                i = _declaration(t, i)
                continue
            i += 1
            x = "interface"
        if x in words and t.word(i + 1) and t.text[i + 1] not in ("extends", "implements") and not (x == "record" and t.text[i + 2 : i + 3] not in (["("], ["<"])):
            if t.text[i + 1] in words and kind == "kotlin":
                i += 1
                continue
            return t.text[i + 1].strip("`"), i + 1
        if x not in MODIFIERS and not (kind == "kotlin" and x in ("fun", "companion")) and not (kind == "java" and x in ("non", "-", "sealed")):
            return None
        i += 1
    return None


def _class_end(t: _Tree, name: int, kind: str) -> int:
    """Position of a class's last token; only Kotlin has classes without braces."""
    j = name + 1
    while j < len(t.text):
        if t.text[j] == "{":
            return t.close.get(j, len(t.text) - 1)
        if kind == "kotlin" and (t.text[j] in (";", "}") or t.line[j] > t.end_line(j - 1) and t.text[j] not in (":", ",", "(", "where", "constructor") and t.text[j - 1] not in (":", ",", "<")):
            return j - 1
        j = t.close.get(j, j) + 1
    return len(t.text) - 1


def grammar_symbols(path: str, text: str, lang: str) -> list[tuple]:
    """Symbols of a file that parses, as ``parse.symbols`` gives them for Python; documentation is a comment directly above."""
    kind = "ecma" if lang in ("javascript", "typescript") else lang
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    tokens = language(lang).tokens(text)
    t, offsets, at = _Tree(tokens), [], 0
    for token in tokens:
        if not token.isspace():
            offsets.append(at)
        at += len(token)
    offsets.append(at)

    def signature(a: int, b: int) -> str:
        return " ".join("".join(" " if t.comment(j) else text[offsets[j] : offsets[j + 1]] for j in range(a, min(b, len(t.text)))).split())

    out: list[tuple] = []
    stack: list[tuple[str, str | None]] = [("top", None)]
    heads: list[tuple[int, int]] = []
    seen: set[int] = set()
    start, parens, before, doc = 0, 0, -1, None
    for i, x in enumerate(t.text):
        if t.comment(i):
            if x.startswith("/**") and len(x) > 4:
                doc = (i, t.end_line(i))
            start = i + 1 if i == start else start
            continue
        opens = i == start or kind != "java" and before >= 0 and t.line[i] > t.end_line(before) and t.text[before] not in OPEN_ENDED
        if opens and not parens and x not in (")", "]", "}", ";", "{"):
            at = _declaration(t, i)
            level = len(stack) - 1
            while level and stack[level][0] == "transparent":
                level -= 1
            owner, parent = stack[level]
            parent = parent if owner == "class" else None
            said = t.text[doc[0]] if doc and doc[0] == before + 1 == i - 1 and t.line[i] <= doc[1] + 1 else None
            got = _class_at(t, at, kind)
            if got and got[1] not in seen:
                seen.add(got[1])
                start = i  # a class without a body ends no statement
                end = _class_end(t, got[1], kind)
                brace = next((j for j in range(got[1], end + 1) if t.text[j] == "{"), end + 1)
                out.append(_symbol(path, "class", got[0], t.line[i if kind != "ecma" else at], t.end_line(end), signature(at, brace), said))
            elif not got and at < len(t.text) and t.text[at] not in CONTROL and (fn := _function_at(t, at, kind, owner == "class")):
                name, p = fn
                bare = kind == "java" and not any(t.text[j] not in MODIFIERS for j in range(at, p - 1))
                if p not in seen and name not in CONTROL and not (bare and name != parent):
                    seen.add(p)
                    start = i
                    end = p
                    while end < len(t.text) and t.text[end] not in ("{", ";", "}"):
                        if kind != "java" and end > p and t.line[end] > t.end_line(end - 1) and t.text[end] not in OPEN_ENDED | {"where"} and t.text[end - 1] not in OPEN_ENDED:
                            end -= 1
                            break
                        end = t.close.get(end, end) + 1
                    last = t.close.get(end, min(end, len(t.text) - 1))
                    if t.text[last] == "}" and last == end:
                        last -= 1
                    body = end if t.text[end : end + 1] in (["{"], [";"], ["}"]) else end + 1
                    out.append(_symbol(path, "function", name, t.line[i if kind != "ecma" else at], t.end_line(last), signature(at, body), said, parent))
        before = i
        if x == "(":
            parens += 1
        elif x == ")":
            parens = max(0, parens - 1)
        elif x == "{":
            stack.append(_owner(t, start, i, kind) if not parens else ("other", None))
            heads.append((start, parens))
            start, parens = i + 1, 0
        elif x == "}":
            if len(stack) > 1:
                stack.pop()
            was, parens = heads.pop() if heads else (i + 1, 0)
            start = was if parens else i + 1
        elif x == ";" and not parens:
            start = i + 1
    return out


def parse_grammar_symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files(file_id, file_path, language, content)`` in the four languages; broken files yield none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for fid, path, lang, content in zip(*(b.column(k).to_pylist() for k in range(4))):
                try:
                    text = text_of(content)
                except UnicodeDecodeError:
                    continue
                if text.strip() and language(lang).check(text, False).ok:
                    found = grammar_symbols(path, text, lang)
                    ids += [fid] * len(found)
                    rows += found
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(FIELDS)]], names=["file_id", *[n for n, _ in FIELDS]])

    src = files.where(F.col("language").isin(LANGUAGES) & F.col("content").isNotNull())
    return src.select(F.col("file_id").cast("bigint").alias("file_id"), F.coalesce("file_path", F.lit("")).alias("file_path"), "language", "content").mapInArrow(run, f"file_id bigint, {DDL}")
