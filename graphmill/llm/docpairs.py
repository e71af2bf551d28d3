"""Functions with their documentation, from parsed source files.

Python files are parsed to syntax trees. Java, TypeScript, JavaScript and Kotlin files go through the
bundled grammars; the walk below then visits their token tree: bracket groups nest, each brace group
knows the declaration that opens it, and a declaration follows its documentation comment.
"""

from __future__ import annotations

import ast
import re
import warnings
from dataclasses import dataclass

import regex

from graphmill.llm.grammar import language


@dataclass
class Function:
    name: str
    parent: str | None  # the class it is a direct member of
    doc: str
    line_start: int
    line_end: int
    signature: str = ""

    def qualified(self, path: str) -> str:
        return f"{path}::{self.parent}.{self.name}" if self.parent else f"{path}::{self.name}"


#: Descriptions that only say that there is none, that it was generated, or where it is.
EMPTY_TALK = re.compile(
    r"(auto[- ]?generated[^.!?]*|generated (by|from|method|code)[^.!?]*|(todo|fixme|xxx|tbd)\b[:. ]*(add|write|fill in|document|description|docs?|documentation|me|this|later|here|the|a|method|function|missing|\W)*"
    r"|(add|write|insert|put|fill in) (a |the |your )?(description|documentation|docs?|comment|text)[^.!?]*|(no|missing|without|empty) (description|documentation|docs?|comment)[^.!?]*|(description|documentation|docs?|docstring|comment)( goes)?( is)?( will be)?( added| written)?( (here|later|missing|needed|to be added|pending|follows|not available|n/a))?"
    r"|(see|refer to|defined in|documented in|described in|same as|inherited from|inherits? from|overrides|documentation (is )?(in|inherited)|description (is )?(in|inherited))\b[^.!?]*|(this|the) (method|function) (is|was) (documented|described|generated|defined)[^.!?]*"
    r"|((description|documentation|docs?|comment|text|this)? ?)?(is |are )?(still )?(to be|will be|needs? to be|has to be|must be|should be) (written|added|documented|described|filled in|completed|provided|supplied)\b[^.!?]*|placeholder[^.!?]*|not (yet )?documented[^.!?]*|undocumented[^.!?]*|n/?a|none|\W*)",
    re.I | re.S,
)
#: Section titles of docstrings whose content describes parameters and the like.
SECTIONS = "Args Arguments Parameters Params Keyword\\ Args Keyword\\ Arguments Other\\ Parameters Returns Return Yields Yield Raises Raise Throws Exceptions Attributes Example Examples See\\ Also Warns Warnings References"
_SECTION = re.compile(r"(?i)^(?:" + "|".join(x.replace("\\ ", " ") for x in re.split(r"(?<!\\) ", SECTIONS)) + r")\s*:?\s*$")
_WORD = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
_PART = regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|\p{Lo}+")


def description(doc: str) -> str:
    """The documentation without comment markers, tags and parameter sections."""
    text = re.sub(r"^\s*/\*\*+|\*+/\s*$", "", doc)
    lines = [re.sub(r"^\s*\*+(?!\w) ?", "", x) if doc.lstrip().startswith("/*") else x for x in text.splitlines()]
    out, skip, tag = [], None, False
    for i, x in enumerate(lines):
        bare, indent = x.strip(), len(x) - len(x.lstrip())
        if re.match(r"[@\\][a-zA-Z]+\b", bare):
            tag = True  # a block tag runs to the next blank line or tag
            continue
        if re.match(r":\w+(\s+[^:]*)?:", bare):
            tag = True
            continue
        if not bare:
            tag = False
            out.append("")
            continue
        if tag:
            continue
        if _SECTION.match(bare) and (bare.endswith(":") or i + 1 < len(lines) and re.fullmatch(r"\s*[-=~]{3,}\s*", lines[i + 1])):
            skip = indent if bare.endswith(":") else -1
            continue
        if skip is not None:
            if skip < 0 or indent > skip:
                continue
            skip = None
        out.append(bare)
    text = re.sub(r"\{@\w+[^}]*\}", " ", "\n".join(out))
    text = re.sub(r"<[^<>]{1,80}>", " ", text)
    return text.strip()


def substantive(doc: str, name: str, least: int = 4) -> bool:
    """Whether at least ``least`` words remain that are not in the function's name, and say something."""
    text = description(doc)
    if EMPTY_TALK.fullmatch(" ".join(text.split()).rstrip(". ")):
        return False
    own = {p.lower() for p in _PART.findall(name)} | {name.lower()}
    return sum(w.lower() not in own for w in _WORD.findall(text)) >= least


def python_functions(text: str) -> list[Function] | None:
    """Functions of a Python file, or null if it does not parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out, todo = [], [(tree, None)]
    while todo:
        node, parent = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(Function(child.name, parent, ast.get_docstring(child) or "", child.lineno, child.end_lineno or child.lineno, f"{child.name}({ast.unparse(child.args)})"))
                todo.append((child, None))
            elif isinstance(child, ast.ClassDef):
                todo.append((child, child.name))
            elif isinstance(child, ast.stmt) or isinstance(child, (ast.ExceptHandler, ast.match_case)):
                todo.append((child, parent))
    return out


#: Words that open a class body, and words that may stand before a declaration's name.
CLASS_WORDS = {"java": {"class", "interface", "enum", "record"}, "kotlin": {"class", "interface", "object"}, "ecma": {"class"}}
MODIFIERS = set("public private protected internal abstract static final open override lateinit const data enum sealed annotation inner value inline noinline crossinline tailrec operator infix external suspend expect actual native synchronized transient volatile strictfp default async get set readonly declare accessor export non-sealed".split())


class _Tree:
    """Tokens without blanks, with lines, and the closing position of every bracket."""

    def __init__(self, tokens: list[str]):
        self.text, self.line, line = [], [], 1
        for t in tokens:
            if not t.isspace():
                self.text.append(t)
                self.line.append(line)
            line += t.count("\n")
        self.close: dict[int, int] = {}
        stack = []
        for i, t in enumerate(self.text):
            if t in ("(", "[", "{"):
                stack.append(i)
            elif t in (")", "]", "}") and stack:
                self.close[stack.pop()] = i

    def comment(self, i: int) -> bool:
        return self.text[i].startswith(("//", "/*"))

    def end_line(self, i: int) -> int:
        return self.line[i] + self.text[i].count("\n")

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.text) and (self.text[i][0].isalpha() or self.text[i][0] in "_$`#")

    def angle(self, i: int) -> int:
        """Position after the type parameters that open at ``i``."""
        depth = 0
        while i < len(self.text):
            depth += {"<": 1, ">": -1, ">>": -2}.get(self.text[i], 0)
            i = self.close.get(i, i) + 1
            if depth <= 0:
                break
        return i


def _after_annotations(t: _Tree, i: int, last: int) -> int | None:
    """Position of the declaration after annotations, or null where a blank line or comment parts it."""
    n = len(t.text)
    while i < n:
        if t.comment(i) or t.line[i] > last + 1:
            return None
        if t.text[i] != "@" or i + 1 < n and t.text[i + 1] == "interface":
            return i
        i += 2
        while i + 1 < n and t.text[i] in (".", ":"):
            i += 2
        if i < n and t.text[i] == "(" and t.line[i] == t.line[i - 1]:
            i = t.close.get(i, i) + 1
        last = t.end_line(i - 1)
    return None


def _function_at(t: _Tree, i: int, kind: str, in_class: bool) -> tuple[str, int] | None:
    """(name, position of its parameter list or arrow) of a function declared at ``i``."""
    n, start = len(t.text), i
    if kind == "kotlin":
        while i < n and (t.text[i] in MODIFIERS or t.text[i] == "@"):
            i += 2 if t.text[i] == "@" else 1
        if i >= n or t.text[i] != "fun" or t.text[i + 1 : i + 2] == ["interface"]:
            return None
        i += 1
        if t.text[i : i + 1] == ["<"]:
            i = t.angle(i)
        while i < n and not (t.text[i] == "(" and t.word(i - 1) and t.text[i - 1] != "fun"):
            if t.text[i] in ("{", "}", ";", "="):
                return None
            i = t.close.get(i, i) + 1
        return (t.text[i - 1].strip("`"), i) if i < n else None
    if kind == "java":
        if not in_class:
            return None
        while i < n and t.text[i] not in ("(", "{", ";", "=", "}"):
            if t.text[i] in CLASS_WORDS["java"] and t.word(i + 1):
                return None
            if t.text[i] == "@":
                i += 1
                if t.text[i + 1 : i + 2] == ["("]:
                    i = t.close.get(i + 1, i + 1)
            i += 1
        return (t.text[i - 1], i) if i < n and t.text[i] == "(" and t.word(i - 1) and i - 1 >= start else None
    # ECMAScript family
    while i < n and t.text[i] in ("export", "default", "declare"):
        i += 1
    j = i + 1 if t.text[i : i + 1] == ["async"] else i
    if t.text[j : j + 1] == ["function"]:
        j += 2 if t.text[j + 1 : j + 2] == ["*"] else 1
        return (t.text[j], j + 1) if t.word(j) and t.text[j + 1 : j + 2] in (["("], ["<"]) else None
    if t.text[i : i + 1] and t.text[i] in ("const", "let", "var"):
        return _arrow(t, i + 1) if t.word(i + 1) else None
    if i < n and (t.word(i) or t.text[i] == "*"):
        while i + 1 < n and t.text[i] in MODIFIERS and t.text[i + 1] not in ("(", "=", ";", ":", "?", "!", "}", ",", "<"):
            i += 1
        i += t.text[i] == "*"
        if not t.word(i):
            return None
        at = i + 1
        if t.text[at : at + 1] == ["<"]:
            at = t.angle(at)
        if t.text[at : at + 1] == ["("]:
            after = t.close.get(at, n) + 1
            if t.text[after : after + 1] == ["{"] or in_class and t.text[after : after + 1] in ([":"], [";"]):
                return t.text[i], at
            return None
        return _arrow(t, i) if in_class else None
    return None


def _arrow(t: _Tree, i: int) -> tuple[str, int] | None:
    """``name [: type] = [async] parameters [: type] => ...``."""
    n, j = len(t.text), i + 1
    while j < n and t.text[j] != "=":
        if t.text[j] in (";", "}", ",", ")"):
            return None
        j = t.close.get(j, j) + 1
    j += 1
    if t.text[j : j + 1] == ["async"]:
        j += 1
    at = j
    if t.text[j : j + 1] == ["<"]:
        j = t.angle(j)
    if t.text[j : j + 1] == ["("]:
        j = t.close.get(j, n) + 1
        if t.text[j : j + 1] == [":"]:
            while j < n and t.text[j] not in ("=>", ";", "}", "="):
                j = t.close.get(j, j) + 1 if t.text[j] != "<" else t.angle(j)
    elif t.word(j):
        j += 1
    return (t.text[i], at) if t.text[j : j + 1] == ["=>"] else None


def _owner(t: _Tree, start: int, brace: int, kind: str) -> tuple[str, str | None]:
    """What the brace at ``brace`` opens: ("class", name), ("transparent", null) or ("other", null)."""
    i, words = start, CLASS_WORDS[kind]
    while i < brace:
        x = t.text[i]
        if x in words and not (i > start and t.text[i - 1] in (".", "::")):
            if kind == "kotlin" and x == "object":
                if t.word(i + 1):
                    return "class", t.text[i + 1]
                return ("transparent", None) if t.text[i - 1] == "companion" else ("other", None)
            if kind == "kotlin" and x == "class" and t.text[i - 1 : i] == ["::"]:
                i += 1
                continue
            if kind == "java" and x == "record" and not t.word(i + 1):
                i += 1
                continue
            return ("class", t.text[i + 1].strip("`")) if t.word(i + 1) and t.text[i + 1] not in ("extends", "implements") else ("other", None)
        i = t.close.get(i, i) + 1 if t.close.get(i, i) < brace else i + 1
    return "other", None


def grammar_functions(text: str, name: str) -> list[Function]:
    """Functions with a documentation comment directly above, in a file that parses."""
    kind = "ecma" if name in ("javascript", "typescript") else name
    t = _Tree(language(name).tokens(text.replace("\r\n", "\n").replace("\r", "\n")))
    out: list[Function] = []
    stack: list[tuple[str, str | None]] = [("top", None)]
    start, open_parens = 0, 0
    heads: list[tuple[int, int]] = []  # what the enclosing level had open
    for i, x in enumerate(t.text):
        if x == "(":
            open_parens += 1
        elif x == ")":
            open_parens = max(0, open_parens - 1)
        elif x == "{":
            stack.append(_owner(t, start, i, kind) if not open_parens else ("other", None))
            heads.append((start, open_parens))
            start, open_parens = i + 1, 0
        elif x == "}":
            if len(stack) > 1:
                stack.pop()
            # Braces inside a head's parentheses don't end the head.
            before, open_parens = heads.pop() if heads else (i + 1, 0)
            start = before if open_parens else i + 1
        elif x == ";" and not open_parens:
            start = i + 1
        elif x.startswith("/**") and len(x) > 4:
            at = _after_annotations(t, i + 1, t.end_line(i))
            level = len(stack) - 1
            while level and stack[level][0] == "transparent":
                level -= 1
            owner = stack[level]
            if at is not None and (got := _function_at(t, at, kind, owner[0] == "class")):
                fn, p = got
                end = p
                while end < len(t.text) and t.text[end] not in ("{", ";", "}"):
                    end = t.close.get(end, end) + 1
                last = t.close.get(end, min(end, len(t.text) - 1))
                sig = " ".join(y for y in t.text[at:end] if not y.startswith(("//", "/*")))
                out.append(Function(fn, owner[1], x, t.line[at], t.line[last], sig))
            start = i + 1 if i == start else start
    return out
