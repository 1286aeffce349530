"""Tokens of brace languages and Ruby, with matched brackets. Columns are UTF-16 code units, lines count from 1."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

OPENING, CLOSING = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(frozen=True)
class Syntax:
    """How a language's text splits into tokens, as patterns. strings: what has to be tried before single marks."""

    line_comments: tuple[str, ...] = ("//",)
    block_comments: bool = True
    strings: tuple[str, ...] = (r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'")
    name: str = r"[^\W\d][\w]*"
    directives: bool = False  # lines that begin with # are a preprocessor's
    templates: bool = False  # `text ${code} text`
    regexes: bool = False  # /pattern/flags where a value may stand

    def compiled(self) -> re.Pattern:
        comments = [c + r"[^\n]*" for c in self.line_comments]
        if self.block_comments:
            comments.append(r"/\*.*?(?:\*/|\Z)")
        if self.directives:
            comments.insert(0, r"(?<![^\n])[ \t]*#(?:\\\r?\n|[^\n])*")
        parts = [r"(?P<space>[ \t\r\f\v]+)", r"(?P<line>\n)"]
        parts.append(f"(?P<comment>{'|'.join(comments)})")
        if self.directives:  # a directive's blanks belong to it
            parts[0], parts[2] = parts[2], parts[0]
        parts += [f"(?P<string>{'|'.join(self.strings)})", f"(?P<name>{self.name})", r"(?P<number>\d(?:[\w.]*\w)?)"]
        parts.append(r"(?P<mark>\.\.\.|=>|->|::|\?\.|:=|<-|&&|\|\||[=!<>]=|[^\s])")
        return re.compile("|".join(parts), re.S)


REGEX_LITERAL = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
VALUE_WORDS = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "if", "unless", "while", "when", "and", "or", "not"}


@dataclass
class Tokens:
    """Parallel lists: kind (name, number, string, mark), text, start and end offset, a line break before; and bracket partners."""

    source: str
    kind: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    broken: list[bool] = field(default_factory=list)
    match: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lines = [0] + [m.end() for m in re.finditer("\n", self.source)]
        self.ascii = self.source.isascii()

    def __len__(self) -> int:
        return len(self.kind)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.lines, offset)
        before = self.source[self.lines[line - 1] : offset]
        return line, len(before) if self.ascii else len(before.encode("utf-16-le")) // 2

    def span(self, first: int, last: int) -> tuple[int, int, int, int]:
        """From the first token's start to the last token's end; broken code may end before that."""
        return (*self.at(self.start[first]), *self.at(self.end[max(first, min(last, len(self) - 1))]))

    def whole(self) -> tuple[int, int, int, int]:
        return (1, 0, *self.at(len(self.source)))

    def word(self, i: int) -> str:
        """The token's text, empty beyond the end."""
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.kind) and self.kind[i] == "name"

    def angle(self, i: int) -> int:
        """The index behind a list of type arguments that begins at i, or i where none does."""
        if self.word(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self):
            w = self.text[j]
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif w in OPENING:
                j = max(j, self.match[j])
            elif self.kind[j] == "mark" and w not in {",", ".", "?", "&", "*", "::", "|", ":", "=", "@", "'", "->", "=>", "...", "+", "-"}:
                return i
            j += 1
        return i


def lex(source: str, syntax: Syntax) -> Tokens:
    out = Tokens(source)
    pattern = syntax.compiled()
    i, broken, held = 0, False, []  # held: brace depths at which a template goes on
    depth = 0

    def put(kind: str, a: int, z: int) -> None:
        nonlocal broken
        out.kind.append(kind)
        out.text.append(source[a:z])
        out.start.append(a)
        out.end.append(z)
        out.broken.append(broken)
        broken = False

    def template(a: int) -> int:
        """From behind a template's mark or hole on: to behind its end, or into the next hole."""
        nonlocal depth
        j = a
        while j < len(source):
            if source[j] == "\\":
                j += 2
            elif source[j] == "`":
                put("string", a - 1, j + 1)
                return j + 1
            elif source.startswith("${", j):
                put("string", a - 1, j)
                held.append(depth)
                depth += 1
                put("mark", j + 1, j + 2)
                return j + 2
            else:
                j += 1
        put("string", a - 1, len(source))
        return len(source)

    while i < len(source):
        c = source[i]
        if c == "`" and syntax.templates:
            i = template(i + 1)
            continue
        if c == "/" and syntax.regexes and (not out.kind or (out.kind[-1] == "mark" and out.text[-1] not in CLOSING) or out.text[-1] in VALUE_WORDS):
            if m := REGEX_LITERAL.match(source, i):
                put("string", i, m.end())
                i = m.end()
                continue
        m = pattern.match(source, i)
        kind, z = m.lastgroup, m.end()
        if kind == "line":
            broken = True
        elif kind == "comment":
            broken = broken or "\n" in m[0]
        elif kind != "space":
            put(kind, i, z)
            if syntax.templates and kind == "mark":
                depth += (c == "{") - (c == "}")
                if c == "}" and held and held[-1] == depth:
                    held.pop()
                    z = template(z)
        i = max(z, i + 1)
    _pair(out)
    return out


def _pair(t: Tokens) -> None:
    t.match = list(range(len(t)))
    stack: list[int] = []
    for k, (kind, w) in enumerate(zip(t.kind, t.text)):
        if kind != "mark":
            continue
        if w in OPENING:
            stack.append(k)
        elif w in CLOSING:
            at = next((n for n in range(len(stack) - 1, -1, -1) if OPENING[t.text[stack[n]]] == w), None)
            if at is not None:
                t.match[stack[at]], t.match[k] = k, stack[at]
                for lost in stack[at + 1 :]:
                    t.match[lost] = k - 1
                del stack[at:]
    for lost in stack:
        t.match[lost] = len(t) - 1
