"""Facts of Ruby: classes, modules and methods between a word and its ``end``, calls, superclasses and local names."""

from __future__ import annotations

from .lexer import OPENING, Syntax, Tokens, lex

SYNTAX = Syntax(
    (r"\#",), block_comments=False, regexes=True, name=r"(?:@@?|\$)?[^\W\d]\w*[?!]?",
    strings=(r"(?<![^\n])=begin\b[\s\S]*?(?:\n=end\b[^\n]*|\Z)", r'"(?:\\[\s\S]|[^"\\])*"', r"'(?:\\[\s\S]|[^'\\])*'", r"<<[~-]?(?P<q>['\"]?)(?P<tag>[A-Z]\w*)(?P=q)[^\n]*\n[\s\S]*?\n[ \t]*(?P=tag)\b", r":[^\W\d]\w*[?!=]?(?!:)"),
)
OPENERS = {"class", "module", "def", "begin", "case", "do", "for"}
GUARDS = {"if", "unless", "while", "until"}  # open a block only where a statement or value begins
WORDS = OPENERS | GUARDS | {"end", "else", "elsif", "when", "then", "in", "rescue", "ensure", "return", "yield", "self", "super", "nil", "true", "false", "and", "or", "not", "break", "next", "redo", "retry", "alias", "undef", "defined?", "__FILE__"}
LISTED = {"require", "require_relative", "attr_reader", "attr_writer", "attr_accessor", "include", "prepend", "extend", "puts", "raise", "private", "protected", "public", "p", "print", "private_constant", "module_function"}


class Front:
    def __init__(self, source: str) -> None:
        self.t: Tokens = lex(source, SYNTAX)
        self.symbols: list[dict] = []
        self.refs: list[dict] = []
        self.scopes: list[dict] = [{"idx": 0, "parent_idx": None, "range": self.t.whole()}]
        self.defs: list[dict] = []
        self.close = self.ends()

    def facts(self) -> dict[str, list[dict]]:
        self.items(0, len(self.t), 0, None)
        return {"symbols": self.symbols, "refs": self.refs, "imports": [], "scopes": self.scopes, "scope_defs": self.defs}

    def ends(self) -> dict[int, int]:
        """The ``end`` of each opening word."""
        t, stack, out = self.t, [], {}
        loop = False  # the do of while .. do
        for i, w in enumerate(t.text):
            if t.kind[i] != "name" or t.word(i - 1) in (".", "&.", "?.") or t.word(i + 1) == ":" and t.word(i + 2) != ":" and t.start[i + 1] == t.end[i]:
                continue
            begins = i == 0 or t.broken[i] or t.text[i - 1] in (";", "=", "(", "[", ",", "{", "=>", "&&", "||", "return", "else", "then", "do", "begin")
            if w == "end":
                if stack:
                    out[stack.pop()] = i
            elif w == "do" and loop and not t.broken[i]:
                loop = False
            elif w in OPENERS or w in GUARDS and begins:
                if w == "def" and self.endless(i):
                    continue
                stack.append(i)
                loop = w in ("while", "until", "for")
            if loop and i + 1 < len(t) and t.broken[i + 1]:
                loop = False
        for i in stack:
            out[i] = len(t) - 1
        return out

    def endless(self, i: int) -> bool:
        """def name(args) = value"""
        t, j = self.t, i + 2
        while t.word(j) == "." and t.is_name(j + 1):
            j += 2
        if t.word(j) == "(":
            return t.word(t.match[j] + 1) == "=" and not t.broken[t.match[j] + 1]
        return False

    def scope(self, parent: int, first: int, last: int) -> int:
        self.scopes.append({"idx": len(self.scopes), "parent_idx": parent, "range": self.t.span(first, last)})
        return len(self.scopes) - 1

    def local(self, scope: int, name: str) -> None:
        self.defs.append({"scope_idx": scope, "name": name, "symbol": None})

    def symbol(self, i: int, kind: str, first: int, last: int, owner: str | None, scope: int, **more) -> None:
        self.symbols.append({"name": self.t.text[i], "kind": kind, "range": self.t.span(first, last), "name_range": self.t.span(i, i), "owner_type": owner, "exported": False, **more})
        self.defs.append({"scope_idx": scope, "name": self.t.text[i], "symbol": len(self.symbols) - 1})

    def ref(self, i: int, role: str, receiver: str | None, args: int | None) -> None:
        self.refs.append({"name": self.t.text[i], "role": role, "range": self.t.span(i, i), "receiver": receiver, "arg_count": args})

    def items(self, i: int, end: int, scope: int, owner: str | None) -> None:
        while i < end:
            i = max(self.item(i, end, scope, owner), i + 1)

    def item(self, i: int, end: int, scope: int, owner: str | None) -> int:
        t, w = self.t, self.t.text[i]
        if t.kind[i] != "name":
            if w == "{" and t.word(i + 1) == "|":
                return self.block(i, t.match[i], scope, owner)
            return i + 1
        last = self.close.get(i)
        if last is not None and w in ("class", "module"):
            at = i + 1
            if not t.is_name(at) and t.word(at) != "<":
                return i + 1
            if t.word(at) == "<":  # class << self
                inner = self.scope(scope, i, last)
                self.items(at + 1, last, inner, owner)
                return last + 1
            while t.word(at + 1) == "::" and t.is_name(at + 2):
                at += 2
            self.symbol(at, w, i, last, owner, scope)
            j = at + 1
            if w == "class" and t.word(j) == "<":
                base = start = j + 1
                while t.word(base + 1) == "::" and t.is_name(base + 2):
                    base += 2
                if t.is_name(base) and t.word(base + 1) not in (".", "("):
                    self.ref(base, "extends", t.source[t.start[start] : t.end[base - 2]] if base > start else None, None)
                    j = base + 1
                else:
                    j = start
            self.items(j, last, self.scope(scope, i, last), t.text[at])
            return last + 1
        if w == "def":
            return self.method(i, last, end, scope, owner)
        if w == "do" and last is not None:
            return self.block(i, last, scope, owner)
        if w == "rescue":
            j = i + 1
            while j < end and not t.broken[j] and t.text[j] != "=>":
                j += 1
            if t.word(j) == "=>" and t.is_name(j + 1):
                self.local(scope, t.text[j + 1])
                return j + 2
            return i + 1
        if w == "for" and last is not None:
            j = i + 1
            while j < last and t.text[j] != "in":
                if t.is_name(j):
                    self.local(scope, t.text[j])
                j += 1
            return j
        if w in WORDS:
            return i + 1
        after = t.word(i + 1)
        member = t.word(i - 1) in (".", "?.") or (t.word(i - 1) == "::" and (after == "(" or w[0].islower()))
        if after == "=" and not member and w[0] not in "@$":
            self.local(scope, w)
        elif after == "(" and t.start[i + 1] == t.end[i]:
            self.ref(i, "call", self.receiver(i) if member else None, self.arguments(i + 1))
        elif member:
            self.ref(i, "call", self.receiver(i), self.loose(i + 1, end))
        elif w[0].islower() and (n := self.loose(i + 1, end)) and after not in ("[",) and w not in LISTED:
            self.ref(i, "call", None, n)
        return i + 1

    def method(self, i: int, last: int | None, end: int, scope: int, owner: str | None) -> int:
        t, at = self.t, i + 1
        while t.word(at + 1) == "." and t.is_name(at + 2):
            at += 2
        stop = last
        j = at + 1
        if t.word(j) == "=" and t.word(j + 1) == "(" and t.start[j] == t.end[at]:  # a setter
            j += 1
        if last is None:
            stop = j
            while stop + 1 < end and not t.broken[stop + 1]:
                stop += 1
        names, variadic = [], False
        if t.word(j) == "(":
            a, b = j + 1, t.match[j]
            j = b + 1
        else:
            a = b = j
            while b < stop and not t.broken[b] and t.text[b] != ";" and last is not None:
                b += 1
            j = b
        depth, fresh = a, True
        while depth < b:
            w = t.text[depth]
            if w == ",":
                fresh = True
            elif w == "*" and fresh:
                variadic = True
            elif t.kind[depth] == "name" and fresh:
                names.append(w)
                fresh = False
            depth = t.match[depth] + 1 if w in OPENING else depth + 1
        inner = self.scope(scope, i, stop)
        for n in names:
            self.local(inner, n)
        if t.is_name(at):
            self.symbol(at, "method", i, stop, owner, scope, param_count=len(names), variadic=variadic)
        self.items(j, stop if last is not None else stop + 1, inner, owner)
        return stop + 1

    def block(self, i: int, last: int, scope: int, owner: str | None) -> int:
        t, inner, j = self.t, self.scope(scope, i, last), i + 1
        if t.word(j) == "|":
            j += 1
            while j < last and t.text[j] != "|":
                if t.is_name(j):
                    self.local(inner, t.text[j])
                j += 1
            j += 1
        self.items(j, last, inner, owner)
        return last + 1

    def arguments(self, p: int) -> int:
        t, n, j, end = self.t, 0, p + 1, self.t.match[p]
        if j >= end:
            return 0
        while j < end:
            n += t.text[j] == ","
            j = t.match[j] + 1 if t.text[j] in OPENING else j + 1
        return n + (t.text[end - 1] != ",")

    def loose(self, i: int, end: int) -> int:
        """Arguments without brackets behind a name, on its line; 0 where none begin there."""
        t = self.t
        if i >= end or t.broken[i] or not (t.kind[i] in ("string", "number") or t.kind[i] == "name" and (t.text[i] not in WORDS or t.text[i] in ("self", "nil", "true", "false"))) or t.start[i] == t.end[i - 1]:
            return 0
        n, j = 1, i
        while j < end and not (t.broken[j] and t.text[j - 1] != ",") and t.text[j] not in (";", ")", "]", "}", "do", "if", "unless", "and", "or"):
            n += t.text[j] == ","
            j = t.match[j] + 1 if t.text[j] in OPENING else j + 1
        return n

    def receiver(self, i: int) -> str | None:
        t, j = self.t, i - 2
        while j >= 0:
            if t.text[j] in (")", "]", "}") and t.match[j] < j:
                j = t.match[j] - 1
                if j >= 0 and t.kind[j] != "name":
                    j += 1
                    break
                continue
            if t.kind[j] not in ("name", "string", "number"):
                j += 1
                break
            if t.word(j - 1) not in (".", "?.", "::"):
                break
            j -= 2
        j = max(j, 0)
        return t.source[t.start[j] : t.end[i - 2]].strip() or None


def parse(source: str) -> dict[str, list[dict]]:
    return Front(source).facts()
