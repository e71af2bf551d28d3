"""Table-driven parsers compiled from bundled grammars.

A source text is cut into tokens and each token becomes one character (its kind). Every bracketed part
of a grammar rule becomes a table of its own: the parser reduces bracket groups from the inside out,
and replaces a group by the list of bracketed rules its content satisfies. Each rule is a node table of
a recursive pattern program (the ``regex`` engine's) with committed, ordered choice, that must consume
its whole token string. Verdicts about a group's content are remembered: token strings repeat far more
than texts do, so most groups are looked up. Where a file fails, the innermost group that satisfies no
rule, and in it the shortest prefix that nothing can complete, give its first unrecoverable token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from importlib import resources

import regex

NL = "\n"
_PIECE = re.compile(r"\s*(?:'([^']+)'|([A-Za-z]\w*)|([()|*+?!&]))")


def rules(text: str, ts: bool) -> dict[str, str]:
    """Rule name -> body; the part after ``@ts`` replaces rules only for TypeScript."""
    out: dict[str, str] = {}
    name = ""
    for line in text.splitlines():
        if line.startswith("@"):
            if not ts:
                break
        elif line.strip() and not line.startswith("#"):
            m = re.match(r"(\w+)\s+= ?(.*)", line)
            if m:
                name = m[1]
                out[name] = m[2]
            else:
                out[name] += " " + line.strip()
    return out


OPEN, CLOSE = "({[", ")}]"


class Tables:
    """Grammar -> pattern programs: one for the whole file and one per bracketed rule part."""

    def __init__(self, body: dict[str, str], chars: dict[str, str], classes: dict[str, str]):
        self.chars, self.classes = chars, classes
        self.parts: dict[str, list[str]] = {k: [] for k in OPEN}  # bracketed parts by kind of bracket
        self.rules = {n: self._fold(self._pieces(n, b)) for n, b in body.items()}
        for k in OPEN:  # parts may hold further brackets; the list grows while it is read
            for i, part in enumerate(self.parts[k]):
                self.rules[self.part(k, i)] = part
        self.uses = {n: {p[1] for p in ps if p[0] == "rule"} for n, ps in self.rules.items()}
        self.recursive = {n for n in self.rules if self._reaches(n)}
        self.done: dict[str, str] = {}
        self.programs: dict[str, regex.Pattern] = {}

    @staticmethod
    def part(kind: str, i: int) -> str:
        return f"{'pbs'[OPEN.index(kind)]}_{i}"

    @staticmethod
    def _pieces(name: str, body: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(body.rstrip()):
            m = _PIECE.match(body, at)
            if not m:
                raise ValueError(f"{name}: {body[at:]}")
            at = m.end()
            lit, word, op = m.groups()
            out.append(("lit", lit) if lit else ("class", word) if word and word[0].isupper() else ("rule", word) if word else ("op", op))
        return out

    def _fold(self, ps: list[tuple[str, str]]) -> list[tuple[str, str]]:
        out, i = [], 0
        while i < len(ps):
            if ps[i][0] == "lit" and ps[i][1] in OPEN and (j := self._partner(ps, i)):
                inner = self._fold(ps[i + 1 : j])
                known = self.parts[ps[i][1]]
                if inner not in known:
                    known.append(inner)
                out.append(("group", f"{ps[i][1]}{known.index(inner)}"))
                i = j
            else:
                out.append(ps[i])
            i += 1
        return out

    @staticmethod
    def _partner(ps: list[tuple[str, str]], i: int) -> int:
        """Index of the bracket that closes ``ps[i]`` in the same sequence, else 0."""
        depth, group = 0, 0
        for j in range(i, len(ps)):
            kind, x = ps[j]
            if kind == "lit" and x in OPEN:
                depth += 1
            elif kind == "lit" and x in CLOSE:
                depth -= 1
                if not depth:
                    return j if group == 0 and x == CLOSE[OPEN.index(ps[i][1])] else 0
            elif kind == "op" and x == "(":
                group += 1
            elif kind == "op" and x == ")":
                group -= 1
                if group < 0:
                    return 0
            elif kind == "op" and x == "|" and group == 0:
                return 0
        return 0

    def _reaches(self, name: str) -> bool:
        seen, todo = set(), list(self.uses[name])
        while todo:
            n = todo.pop()
            if n == name:
                return True
            if n not in seen:
                seen.add(n)
                todo += self.uses[n]
        return False

    def _ref(self, name: str) -> str:
        return f"(?&{name})" if name in self.recursive else f"(?>{self._compile(name)})"

    def _compile(self, name: str) -> str:
        if name not in self.done:
            out: list = []
            for kind, x in self.rules[name]:
                if kind == "lit":
                    # A closing bracket can only be met at the end of a group's content.
                    out.append(r"\Z" if x in CLOSE else re.escape(self.chars[x]))
                elif kind == "class":
                    out.append(self.classes[x])
                elif kind == "rule":
                    out.append(self._ref(x))
                elif kind == "group":
                    o, c = re.escape(self.chars[x[0]]), re.escape(self.chars[CLOSE[OPEN.index(x[0])]])
                    bit = re.escape(chr(0xF000 + int(x[1:])))
                    out.append(f"(?>{o}[^{bit}{c}]*+{bit}[^{c}]*+{c})")
                elif x == "(":
                    out.append("(?>")
                elif x in ")|":
                    out.append(x)
                elif x in "*+?":
                    out.append(x + "+")
                else:
                    out.append("(?!" if x == "!" else "(?=")
                    out.append(None)  # closes after the next item: a literal, a class, a rule or a group
            self.done[name] = self._close(out)
        return self.done[name]

    @staticmethod
    def _close(parts: list) -> str:
        out, depth, open_at = [], 0, []
        for p in parts:
            if p is None:
                open_at.append(depth)
                continue
            out.append(p)
            if p == "(?>":
                depth += 1
                continue
            if p == ")":
                depth -= 1
            if p not in ("(?!", "(?="):
                while open_at and open_at[-1] == depth:
                    out.append(")")
                    open_at.pop()
        return "".join(out)

    def foreign(self, name: str) -> re.Pattern:
        """Finds a character that no token string derived from ``name`` can hold."""
        need, todo = set(), [name]
        while todo:
            n = todo.pop()
            if n not in need:
                need.add(n)
                todo += self.uses[n]
        own = {"\\uf000-\\uf7ff"}
        for n in need:
            for kind, x in self.rules[n]:
                if kind == "lit" or kind == "group":
                    own.update(re.escape(self.chars[y]) for y in ([x[0], CLOSE[OPEN.index(x[0])]] if kind == "group" else [x]))
                elif kind == "class" and len(c := self.classes[x]) == 1:
                    own.add(c)
                elif kind == "class" and c.startswith("["):
                    own.add(c[1:-1])
        return re.compile("[^" + "".join(sorted(own)) + "]")

    def program(self, name: str) -> regex.Pattern:
        """Matches token strings that ``name`` derives as a whole."""
        if name not in self.programs:
            need, todo = set(), [name]
            while todo:
                n = todo.pop()
                if n not in need:
                    need.add(n)
                    todo += self.uses[n]
            defs = "".join(f"(?<{n}>{self._compile(n)})" for n in sorted(need & self.recursive))
            self.programs[name] = regex.compile(f"(?(DEFINE){defs})(?>{self._ref(name)})\\Z")
        return self.programs[name]


@dataclass
class Verdict:
    ok: bool
    line: int = 0
    reason: str = ""


class Lexicon(dict):
    """Token text -> token character; unknown words and literals are classed once and remembered."""

    LIMIT = 300_000

    def __init__(self, classify):
        super().__init__()
        self.classify = classify

    def __missing__(self, token: str) -> str:
        if len(self) > self.LIMIT:
            self.clear()
        c = self.classify(token)
        if len(token) < 64:
            self[token] = c
        return c


#: Words and operators of the languages.
ECMA_HARD = "var const if else for while do return throw break continue switch case default try catch finally debugger import export with class function new typeof void delete this super null true false in instanceof extends enum".split()
ECMA_SOFT = "let await async of yield static get set accessor as from type assert".split()
TS_SOFT = "interface namespace module declare global abstract implements public private protected readonly override satisfies is asserts keyof unique infer out".split()
ECMA_OPS = "{ } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ ... => ?. ++ --".split()
ECMA_BINARY = "< + - * / % & | ^ in instanceof".split()
ECMA_BINARY_LONG = "** << <= == != === !== && || ??".split()
ECMA_ASSIGN = "+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()
JAVA_HARD = "package import static final default synchronized class interface enum extends implements throws void if else for while do return throw break continue try catch finally switch case assert this super new instanceof".split()
JAVA_SOFT = "record sealed permits yield when".split()
JAVA_MODIFIER = "public private protected abstract native transient volatile strictfp non-sealed".split()
JAVA_PRIM = "boolean byte short char int long float double".split()
JAVA_UNUSED = "goto const _".split()
JAVA_OPS = "{ } ( ) [ ] ; , . @ < > = ? : & | + - ! ~ * && ... -> :: ++ --".split()
JAVA_BINARY = "< + - * & | &&".split()
JAVA_BINARY_LONG = "/ % ^ << <= == != ||".split()
JAVA_ASSIGN = "+= -= *= /= %= &= |= ^= <<=".split()
KOTLIN_HARD = "package class interface fun object val var typealias this super null true false if else when try throw return continue break for while do in is as".split()
KOTLIN_SOFT = "import where by get set init constructor companion catch finally dynamic suspend".split()
KOTLIN_MODIFIER = "public private protected internal abstract final open override lateinit const data enum sealed annotation inner value inline noinline crossinline reified tailrec operator infix external vararg expect actual out".split()
KOTLIN_OPS = "{ } ( ) [ ] ; , . ?. :: : @ < > = ? & * + - ! ++ -- !! -> as? !in !is".split()
KOTLIN_BINARY = "< * + - in !in".split()
KOTLIN_BINARY_LONG = "/ % == != === !== <= && || ?: .. ..<".split()
KOTLIN_ASSIGN = "+= -= *= /= %=".split()


class Language:
    """Lexer and parse table of one language."""

    def __init__(self, grammar: str, hard: list[str], soft: list[str], ops: list[str], groups: dict[str, list[str]], scan: str, kinds, ts: bool = False, no_nl_after: list[str] | None = None, no_nl_before: list[str] | None = None):
        grouped = "(?<" in scan.replace("(?<=", "").replace("(?<!", "")
        self.scan = regex.compile(f"({scan})" if grouped else scan, regex.S | regex.V1)
        self.first = grouped
        self.last: tuple[str, list[str]] = ("", [])
        chars: dict[str, str] = {}
        for w in [*hard, *soft, *ops, *[x for g in groups.values() for x in g]]:
            chars.setdefault(w, chr(0xE000 + len(chars)))
        classes = {"IDENT": "[i" + "".join(chars[w] for w in soft) + "]", "WORD": "[i" + "".join(chars[w] for w in [*hard, *soft, *[x for g in groups.values() for x in g if x.isidentifier()]]) + "]"}
        classes |= {"NUM": "n", "STR": "s", "LIT": "n", "TPL": "t", "REGEX": "r", "PRIV": "p", "LABEL": "l", "NL": NL, "EOF": r"\Z", "NEVER": "(?!)", "NOSPACE": ""}
        for g, words in groups.items():
            classes[g] = "[" + "".join(re.escape(chars[w]) for w in words) + "]"
        classes["ENDED"] = ""
        self.chars = chars
        text = resources.files("graphmill.llm.grammars").joinpath(grammar).read_text()
        # Group contents are listed by these characters, one for each bracketed rule part.
        self.tables = Tables(rules(text, ts), chars, classes)
        self.lexicon = Lexicon(lambda t: self._classify(t, kinds))
        self.trim = None
        if no_nl_after is not None:
            a, b = ("[" + "".join(re.escape(chars[w]) for w in ws) + "]" for ws in (no_nl_after, no_nl_before))
            self.trim = re.compile(f"(?<=\n)\n+|(?<={a})\n+|\n+(?={b})|\\A\n+")
        self.inner = kinds.get("inner")
        o, c = ([re.escape(chars[x]) for x in y] for y in (OPEN, CLOSE))
        none = "".join(o + c)
        # Marks of reduced groups: the bracket characters moved to another range.
        self.marks = {chars[x]: chr(0xF800 + i) for i, x in enumerate(OPEN + CLOSE)}
        self.innermost = re.compile("|".join(f"({x}[^{none}]*{y})" for x, y in zip(o, c)))
        self.left = re.compile(f"[{none}]")
        self.kind = {chars[x]: x for x in OPEN}
        for x, m in self.marks.items():  # programs see reduced groups only
            self.tables.chars = self.tables.chars | {k: m for k, v in chars.items() if v == x}
        classes["ENDED"] = "(?<=[" + "".join(re.escape(self.tables.chars[w]) for w in (")", "}", "++", "--")) + "])"
        comma = re.escape(chars[","])
        self.run = re.compile(f"([^{comma}\\n]{{1,16}}{comma}\\n?)\\1{{3,}}")
        self.item = re.compile(f"{re.escape(chars['-'])}?[nst]{comma}\\n?")
        self.items = re.compile(f"(?:{self.item.pattern}){{8,}}")
        ends = re.escape(chars[";"]) + NL
        self.cut = re.compile(f"(?<=[{ends}])")
        self.known: dict[str, str] = {}
        self.pieces: dict[tuple[str, str], bool] = {}
        self.lists = self._lists(self.tables.parts["{"])
        self.alien: dict[str, re.Pattern] = {}

    def _lists(self, parts: list) -> dict[str, str]:
        """Parts that derive whatever they derive followed by what another part derives (their tail)."""
        name = {i: self.tables.part("{", i) for i in range(len(parts))}
        out, members = {"program": "program"} if self.tables.rules["program"][:2] == [("rule", "stmt"), ("op", "*")] else {}, None
        for i, p in enumerate(parts):
            words = [x for k, x in p if k == "rule"]
            if len(p) == 2 and p[1] == ("op", "*") and words in (["stmt"], ["bstmt"], ["member"]) or p == [("rule", "body")]:
                out[name[i]] = name[i]
            elif words == ["member", "semis"]:
                out[name[i]] = members = name[i]
        for i, p in enumerate(parts):
            words = [x for k, x in p if k == "rule"]
            if words == ["lparams", "body"]:
                out[name[i]] = next(n for j, n in name.items() if parts[j] == [("rule", "body")])
            elif words == ["entries", "member", "semis"]:
                out[name[i]] = members
        return out

    def _classify(self, token: str, kinds: dict) -> str:
        if token in self.chars:
            return self.chars[token]
        if token.isspace() or token.startswith(("//", "/*", "#!")):
            if token.startswith("/*") and not (token.endswith("*/") and len(token) > 3):
                return "?"
            return NL if self_newline(token) else ""
        return kinds["of"](token)

    def tokens(self, text: str) -> list[str]:
        """The tokens of a text; those of the last long one are kept, as a walk and a verdict need the same."""
        if text == self.last[0]:
            return self.last[1]
        found = self.scan.findall(text)
        found = [t[0] for t in found] if self.first else found
        if len(text) > 200:  # not the expressions inside templates
            self.last = (text, found)
        return found

    def stream(self, tokens: list[str]) -> str:
        s = "".join(map(self.lexicon.__getitem__, tokens))
        if self.trim is None:
            return s.replace(NL, "")
        return self.trim.sub("", s)

    def _derives(self, name: str, content: str) -> bool:
        if name not in self.alien:
            self.alien[name] = self.tables.foreign(name)
        if self.alien[name].search(content):
            return False
        if name in self.lists:
            # If every piece is derived on its own the whole is; otherwise the whole is tried.
            use = name
            for piece in self.cut.split(content):
                key = (use, piece)
                ok = self.pieces.get(key)
                if ok is None:
                    if len(self.pieces) > 400_000:
                        self.pieces.clear()
                    ok = self.pieces[key] = self.tables.program(use).match(piece) is not None
                if not ok:
                    return self.tables.program(name).match(content) is not None
                use = self.lists[name]
            return True
        return self.tables.program(name).match(content) is not None

    def _reduced(self, group: str) -> str:
        """The mark of one bracket group: which bracketed rule parts its content satisfies.

        Every comma of the grammars stands in a loop over one kind of element, so a run of equal short
        elements (a table of numbers, say) is decided by three of them, and one of literals by its first,
        its last and one of each kind.
        """
        if len(group) > 60:
            group = self.items.sub(lambda m: "".join([(x := self.item.findall(m[0]))[0], *dict.fromkeys(x), x[-1]]), group)
            group = self.run.sub(r"\1\1\1", group)
        got = self.known.get(group)
        if got is None:
            kind = self.kind[group[0]]
            bits = "".join(chr(0xF000 + i) for i in range(len(self.tables.parts[kind])) if self._derives(self.tables.part(kind, i), group[1:-1]))
            got = self.marks[group[0]] + bits + self.marks[group[-1]]
            if len(group) < 400:
                if len(self.known) > 400_000:
                    self.known.clear()
                self.known[group] = got
        return got

    def _top(self, s: str) -> str | None:
        """The token string with all bracket groups reduced, or null if brackets do not pair."""
        n = 1
        while n:
            s, n = self.innermost.subn(lambda m: self._reduced(m[0]), s)
        return None if self.left.search(s) else s

    def check(self, text: str, where: bool = True) -> Verdict:
        """Whether the whole text parses; else, if ``where``, the line of the first unrecoverable token."""
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        tokens = self.tokens(text)
        top = self._top(self.stream(tokens))
        if top is None or not self._derives("program", top):
            return Verdict(False, self._line(tokens) if where else 0, "unexpected token")
        if self.inner:
            for t in tokens:
                for sub in self.inner(t):
                    if not self._expression(sub):
                        return Verdict(False, text[: text.find(t)].count("\n") + 1, "template expression")
        return Verdict(True)

    def _expression(self, text: str) -> bool:
        """Whether a template's expression parses, and those of the templates in it, however deep."""
        todo = [text]
        while todo:
            tokens = self.tokens(todo.pop())
            top = self._top(self.stream(tokens).strip(NL))
            if top is None or not self.tables.program("expr").match(top):
                return False
            todo += [x for t in tokens for x in self.inner(t)]
        return True

    def _line(self, tokens: list[str]) -> int:
        """Line of the first token that no continuation can save."""
        lines, line, kept = [], 1, []
        for t in tokens:
            c = self.lexicon[t]
            if c:
                kept.append((c, line))
            line += t.count(NL)
        last = line
        s = "".join(c for c, _ in kept)
        if self.trim is not None:  # line ends that matter keep their places
            drop = set()
            for m in self.trim.finditer(s):
                drop.update(range(m.start(), m.end()))
            kept = [x for i, x in enumerate(kept) if i not in drop]
        else:
            kept = [x for x in kept if x[0] != NL]
        stack: list[tuple[str, list[tuple[str, int]]]] = [("", [])]
        closers = {self.chars[c]: self.chars[o] for o, c in zip(OPEN, CLOSE)}
        for c, at in kept:
            if c in self.kind:
                stack.append((c, [(c, at)]))
            elif c in closers:
                if stack[-1][0] != closers[c]:
                    return self._stuck([self.tables.part(self.kind[stack[-1][0]], i) for i in range(len(self.tables.parts[self.kind[stack[-1][0]]]))], stack[-1][1][1:], at) if stack[-1][0] else at
                o, own = stack.pop()
                mark = self._reduced("".join(x for x, _ in own) + c)
                if len(mark) == 2:
                    return self._stuck([self.tables.part(self.kind[o], i) for i in range(len(self.tables.parts[self.kind[o]]))], own[1:], at)
                stack[-1][1].append((mark, own[0][1]))
            else:
                stack[-1][1].append((c, at))
        if len(stack) > 1:
            o, own = stack[-1]
            return self._stuck([self.tables.part(self.kind[o], i) for i in range(len(self.tables.parts[self.kind[o]]))], own[1:], last)
        return self._stuck(["program"], stack[0][1], last)

    def _stuck(self, names: list[str], content: list[tuple[str, int]], end: int) -> int:
        best = 0
        for n in names:
            lo, hi = 0, len(content)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                if self.tables.program(n).match("".join(c for c, _ in content[:mid]), partial=True) is not None:
                    lo = mid
                else:
                    hi = mid - 1
            best = max(best, lo)
        return content[best][1] if best < len(content) else end


def self_newline(token: str) -> bool:
    return "\n" in token or token.startswith(("//", "#!")) and False


_WORD = r"[\p{L}\p{Nl}_$][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}$‌‍]*+"
_NUM = r"0[xX][0-9a-fA-F_]++(?:\.[0-9a-fA-F]*+[pP][+-]?\d++)?[nLl]?|0[bB][01_]++[nLl]?|0[oO][0-7_]++n?|(?:\d[\d_]*+(?:\.(?!\.)(?:\d[\d_]*+)?+)?|\.\d[\d_]*+)(?:[eE][+-]?\d++)?[nLlfFdDu]?"
_TEMPLATE = r"(?<tpl>`(?:[^`\\$]|\\.|\$(?!\{)|\$(?<br>\{(?:[^{}`'\"/]|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|/\*.*?\*/|/|(?&tpl)|(?&br))*+\}))*+`)"
_ECMA_SCAN = (
    r"(?:\s++|//[^\n  ]*+|/\*.*?\*/|\A\#![^\n]*+|" + _WORD.replace(r"[\p{L}\p{Nl}_$]", r"(?:[\p{L}\p{Nl}_$]|\\u[0-9a-fA-F]{4})", 1) + r"|\#" + _WORD + "|" + _NUM
    + r"|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|" + _TEMPLATE
    + r"|(?<=(?:\A|[(,;=:\[!&|?{}+\-*%<>~^\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else))[ \t\n]*+)/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"
    + r"|\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\*\*|\+\+|--|<<|<=|==|!=|&&|\|\||\?\?|\?\.(?!\d)|[+\-*/%&|^]=|.)"
)
_JAVA_SCAN = (
    r"(?:\s++|//[^\n]*+|/\*.*?\*/|non-sealed\b|" + _WORD + "|" + _NUM + r"|\"\"\"[ \t]*+\n(?:[^\\\"]|\\.|\"(?!\"\"))*+\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\u++[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'"
    r"|\.\.\.|->|::|\+\+|--|<<=|<<|<=|==|!=|&&|\|\||[+\-*/%&|^]=|.)"
)
_KBR = r"\$(?<br>\{(?:[^{}\"'/]|'(?:[^'\\\n]|\\[^\n])++'|'|/|(?<str>\"\"\"(?:[^\"$]|\"(?!\"\")|\$(?!\{)|\$(?&br))*+\"{3,}|\"(?:[^\"\\\n$]|\\.|\$(?!\{)|\$(?&br))*+\")|(?&br))*+\})"
_KOTLIN_SCAN = (
    r"(?:\s++|//[^\n]*+|(?<cm>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&cm))*+\*/)|\A\#![^\n]*+|(?:return|break|continue|this|super)@" + _WORD.replace("$", "") + "|" + _WORD.replace("_$", "_").replace("$\\u", "\\u") + r"@(?=\s*[{\w])|(?:as\?|!in\b|!is\b)|`[^`\n]++`|" + _WORD + "|" + _NUM
    + r"|\"\"\"(?:[^\"$]|\"(?!\"\")|\$(?!\{)|" + _KBR + r")*+\"{3,}|\"(?:[^\"\\\n$]|\\.|\$(?!\{)|\$(?&br))*+\"|'(?:[^'\\\n]|\\u[0-9a-fA-F]{4}|\\[^\n])'"
    r"|\.\.<|\.\.|===|!==|->|::|\?\.|\?:|\+\+|--|!!|<=|==|!=|&&|\|\||[+\-*/%]=|.)"
)


def _strings(token: str) -> list[str]:
    """Expressions inside ``${}`` of a template or string, outermost only."""
    if "${" not in token or token[0] not in "`\"":
        return []
    out, i = [], 1
    while (i := token.find("${", i)) >= 0:
        back = len(token[:i]) - len(token[:i].rstrip("\\"))
        if back % 2 and not token.startswith('"""'):
            i += 2
            continue
        depth, j, quote = 1, i + 2, ""
        while j < len(token) and depth:
            c = token[j]
            if quote:
                if c == "\\":
                    j += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'`":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            j += 1
        out.append(token[i + 2 : j - 1])
        i = j
    return out


#: What no literal of a language may hold: escapes it does not know, digits outside the base.
_ECMA_BAD = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))")
_JAVA_BAD = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[^btnfrs\"'\\0-7u\n]|u+(?![0-9a-fA-F]{4}))")
_KOTLIN_BAD = re.compile(r"(?<!\\)(?:\\\\)*\\(?:[^tbnr'\"\\$u]|u(?![0-9a-fA-F]{4}))")
_ECMA_NUMBER = re.compile(r"0[0-9_]+n|0\d*_\d*|.*__.*|.*_n?")
_JAVA_NUMBER = re.compile(r"0[0-7_]*[89][0-9_]*[lL]?|[^fFdD.eE]*_[lL]?")


def _closed_pattern(t: str) -> bool:
    """Whether the groups and classes of a pattern literal close."""
    depth = inside = i = 0
    while i < len(t):
        c = t[i]
        if c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                return False
        i += 1
    return depth == 0 and not inside


def _kind(quotes: str, template: str = "", regexes: bool = False, escapes: re.Pattern | None = None, numbers: re.Pattern | None = None):
    def of(t: str) -> str:
        c = t[0]
        if c in quotes:
            if escapes is not None and c not in template and "\\" in t and escapes.search(t):
                return "?"
            return ("t" if c in template else "s") if len(t) > 1 and t[-1] == c else "?"
        if c.isdigit() or c == "." and len(t) > 1:
            return "?" if numbers is not None and numbers.fullmatch(t) else "n"
        if c == "#" and len(t) > 1:
            return "p"
        if regexes and c == "/" and len(t) > 1:
            return "r" if _closed_pattern(t[1 : t.rindex("/")]) else "?"
        if c.isalpha() or c in "_$\\":
            return "i"
        return "?"

    return of


def _kotlin_kind(t: str) -> str:
    if t.endswith("@") and len(t) > 1:
        return "l"
    if t[0] == "`":
        return "i" if len(t) > 2 else "?"
    if t[0] in "\"'":
        if len(t) < 2 or t[-1] != t[0] or "\\" in t and not t.startswith('"""') and "${" not in t and _KOTLIN_BAD.search(t):
            return "?"
        return "s" if t[0] == '"' else "n"
    return _kotlin_rest(t)


def build(language: str) -> Language:
    if language in ("javascript", "typescript"):
        ts = language == "typescript"
        soft = ECMA_SOFT + (TS_SOFT if ts else TS_SOFT)
        after = [*"{ ( [ , < > + - * / % & | ^ ! ~ ? : = . ... => ?.".split(), *ECMA_BINARY_LONG, *ECMA_ASSIGN, ";", "else", "do", "in", "instanceof", "extends", "case", "typeof", "new"]
        after.remove("!")
        before = [*") ] , . ?. ? : = => * / % & | ^ < >".split(), *[x for x in ECMA_BINARY_LONG if x != "!="], "!=", *ECMA_ASSIGN, "else", "catch", "finally", "in", "instanceof", "{", "}"]
        return Language("ecma.g", ECMA_HARD, soft, ECMA_OPS, {"BINOP": ECMA_BINARY + ECMA_BINARY_LONG, "ASSIGN": ECMA_ASSIGN}, _ECMA_SCAN, {"of": _kind("'\"`", "`", True, _ECMA_BAD, _ECMA_NUMBER), "inner": lambda t: _strings(t) if t[0] == "`" else []}, ts, after, before)
    if language == "java":
        return Language("java.g", JAVA_HARD + JAVA_UNUSED, JAVA_SOFT, JAVA_OPS, {"MODIFIER": JAVA_MODIFIER, "PRIM": JAVA_PRIM, "BINOP": JAVA_BINARY + JAVA_BINARY_LONG, "ASSIGN": JAVA_ASSIGN}, _JAVA_SCAN, {"of": _java_kind})
    if language == "kotlin":
        after = [*"{ ( [ , < . ?. :: : = & * + - ! ? @ -> as? !in !is".split(), *KOTLIN_BINARY_LONG, *KOTLIN_ASSIGN, ";", "else", "in", "as", "is"]
        after.remove("@"), after.remove("?"), after.remove("*")
        before = [*") ] } , . ?. : = -> as? { ?".split(), "&&", "||", "?:", "else", "catch", "finally", "as", "by", "where"]
        return Language("kotlin.g", KOTLIN_HARD, KOTLIN_SOFT + KOTLIN_MODIFIER, KOTLIN_OPS, {"MODIFIER": KOTLIN_MODIFIER + ["suspend"], "BINOP": KOTLIN_BINARY + KOTLIN_BINARY_LONG, "ASSIGN": KOTLIN_ASSIGN}, _KOTLIN_SCAN, {"of": _kotlin_word, "inner": lambda t: _strings(t) if t[0] == '"' else []}, False, after, before)
    raise ValueError(language)


def _java_kind(t: str) -> str:
    if t in ("true", "false", "null"):
        return "n"
    if t[0] == "'":
        return "n" if len(t) > 2 and t[-1] == "'" and not ("\\" in t and _JAVA_BAD.search(t)) else "?"
    return _java_rest(t)


_java_rest = _kind('"', escapes=_JAVA_BAD, numbers=_JAVA_NUMBER)
_kotlin_rest = _kind("")


def _kotlin_word(t: str) -> str:
    return _kotlin_kind(t)


_languages: dict[str, Language] = {}


def language(name: str) -> Language:
    if name not in _languages:
        _languages[name] = build(name)
    return _languages[name]
