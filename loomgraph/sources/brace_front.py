"""Facts of languages whose blocks are in braces, by one recursive pass over matched tokens.

A Language says which words begin types, functions, imports and bindings, whether declarations are written type first, and how
supertypes are listed. The pass is lexical: no grammar is needed, broken code gives what can be recognised, and anything between
brackets is visited once. It finds types, functions, methods and properties with owners, modifiers and arity; calls with
receivers and argument counts; supertypes; imports; and a scope per type, function and block with its local names.
"""

from __future__ import annotations

from dataclasses import dataclass

from .lexer import OPENING, Syntax, Tokens, lex

#: Words that aren't called although a bracket may follow, in all languages and in some.
CONTROL = {
    "if", "for", "while", "switch", "catch", "return", "throw", "sizeof", "function", "super", "this", "do", "else", "case", "yield", "in", "is", "as", "try", "new", "delete", "not", "and", "or", "import", "default",
}
MORE_CONTROL = {
    "go": {"func", "go", "defer", "select", "range"}, "rust": {"fn", "loop", "match", "unsafe", "where", "move"}, "kotlin": {"fun", "when", "constructor", "init", "get", "set", "where"}, "scala": {"def", "match", "given", "using"},
    "php": {"fn", "foreach", "elseif", "isset", "unset", "empty", "list", "array", "echo", "print", "include", "require", "declare", "match"}, "java": {"synchronized"},
    "csharp": {"foreach", "using", "lock", "typeof", "nameof", "checked", "unchecked", "fixed", "await", "when", "where", "get", "set", "init"}, "c": {"alignof", "defined"}, "cpp": {"alignof", "decltype", "static_assert", "noexcept", "defined", "typeid"},
    **dict.fromkeys(("typescript", "tsx", "javascript"), {"typeof", "await", "of", "void"}),
}
ACCESS = {".", "?.", "::"}
VISIBILITIES = ("public", "protected", "private")


@dataclass(frozen=True)
class Language:
    syntax: Syntax
    types: dict[str, str]  # word: symbol kind
    functions: tuple[str, ...] = ()
    bindings: tuple[str, ...] = ()
    modifiers: tuple[str, ...] = ()
    member: str = "function"  # kind of a function in a type
    typed: bool = False  # type before name
    bare_members: bool = False  # name(..) { in a type is a method
    heritage: tuple[tuple[str, str], ...] = ()  # word or mark that begins a list of supertypes, and its role
    calls_bases: bool = False  # a supertype may be invoked: Base()
    property_kind: str | None = None  # bindings outside of functions are symbols of this kind
    closed_types: tuple[str, ...] = ()  # types whose bodies hold no members
    lines: bool = False  # a line break may end a declaration
    needs_body: bool = False  # a function without a body is no symbol
    marks_modifiers: bool = False


_DOC = r'"""[\s\S]*?(?:"""|\Z)'
_PLAIN = Syntax().strings
_C_LIKE = Syntax(strings=(r'[LuU]?R"\((?:[^)]|\)(?!"))*\)"', *_PLAIN), directives=True)
_SCRIPT = Language(
    Syntax(name=r"[^\W\d][\w$]*|[$#@]?[^\W\d][\w$]*|\$[\w$]*", templates=True, regexes=True),
    {"class": "class", "interface": "interface", "namespace": "module", "module": "module", "enum": "enum"},
    ("function",), ("const", "let", "var"), ("export", "default", "declare", "abstract", "async", "static", "public", "private", "protected", "readonly", "override", "get", "set", "accessor"),
    "method", bare_members=True, heritage=(("extends", "extends"), ("implements", "implements")), closed_types=("enum",), lines=True, marks_modifiers=True,
)
LANGUAGES: dict[str, Language] = {
    "typescript": _SCRIPT, "tsx": _SCRIPT, "javascript": _SCRIPT,
    "java": Language(
        Syntax(strings=(_DOC, *_PLAIN), name=r"[^\W\d][\w$]*"), {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}, (), (),
        ("public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"), "method", typed=True,
        heritage=(("extends", "extends"), ("implements", "implements")), marks_modifiers=True,
    ),
    "csharp": Language(
        Syntax(strings=(_DOC, r'[$@]{1,2}"(?:""|[^"])*"', *_PLAIN), name=r"@?[^\W\d]\w*", directives=True),
        {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "record": "record", "namespace": "module"}, (), (),
        ("public", "protected", "private", "internal", "static", "abstract", "sealed", "virtual", "override", "async", "readonly", "partial", "extern", "unsafe", "new", "const", "required", "file"), "method", typed=True,
        heritage=((":", "extends"),), calls_bases=True, property_kind="property", closed_types=("enum",),
    ),
    "c": Language(_C_LIKE, {"struct": "class", "union": "class", "enum": "type"}, (), (), ("static", "extern", "inline", "const", "volatile", "register"), typed=True, closed_types=("struct", "union", "enum")),
    "cpp": Language(
        _C_LIKE, {"class": "class", "struct": "class", "union": "class", "enum": "type", "namespace": "module"}, (), (),
        ("static", "extern", "inline", "const", "constexpr", "virtual", "explicit", "friend", "mutable", "volatile", "typename"), "method", typed=True, heritage=((":", "extends"),), closed_types=("enum",),
    ),
    "go": Language(
        Syntax(strings=(r"`[^`]*`", *_PLAIN)), {}, ("func",), ("var", "const"), (), "method", lines=True,
    ),
    "rust": Language(
        Syntax(strings=(r'b?r(?P<hashes>#*)"[\s\S]*?"(?P=hashes)', r'b?"(?:\\[\s\S]|[^"\\])*"', r"b?'(?:\\(?:.|x\w\w|u\{\w+\})|[^'\\\n])'")),
        {"struct": "class", "enum": "class", "union": "class", "trait": "interface", "mod": "module", "type": "class"}, ("fn",), ("let", "const", "static"), ("pub", "async", "unsafe", "extern", "default"), "method",
        closed_types=("struct", "enum", "union", "type"), needs_body=True,
    ),
    "kotlin": Language(
        Syntax(strings=(_DOC, *_PLAIN), name=r"[^\W\d]\w*|`[^`\n]+`"), {"class": "class", "interface": "interface", "object": "object"}, ("fun",), ("val", "var"),
        ("public", "protected", "private", "internal", "open", "abstract", "final", "sealed", "data", "enum", "annotation", "inner", "override", "suspend", "inline", "infix", "operator", "lateinit", "const", "companion", "value", "tailrec", "external"),
        heritage=((":", "extends"),), calls_bases=True, property_kind="property", lines=True,
    ),
    "scala": Language(
        Syntax(strings=(_DOC, *_PLAIN[:1], r"'(?:\\.|[^'\\\n])'"), name=r"[^\W\d]\w*|`[^`\n]+`"), {"class": "class", "trait": "interface", "object": "object", "enum": "enum"}, ("def",), ("val", "var"),
        ("private", "protected", "implicit", "override", "final", "sealed", "abstract", "lazy", "case", "inline", "given", "open"), heritage=(("extends", "extends"), ("with", "extends")), calls_bases=True,
        property_kind="variable", lines=True,
    ),
    "php": Language(
        Syntax(("//", r"\#(?!\[)"), strings=(r"<<<\s*['\"]?(?P<tag>\w+)['\"]?\r?\n[\s\S]*?\n\s*(?P=tag)\b", r'"(?:\\[\s\S]|[^"\\])*"', r"'(?:\\[\s\S]|[^'\\])*'"), name=r"\$?[^\W\d]\w*"),
        {"class": "class", "interface": "interface", "trait": "interface", "enum": "enum"}, ("function", "fn"), (), ("public", "protected", "private", "static", "abstract", "final", "readonly"), "method",
        heritage=(("extends", "extends"), ("implements", "implements")),
    ),
}


class Front:
    """The facts of one text. Positions are token indices until they go out."""

    def __init__(self, name: str, source: str) -> None:
        self.id, self.lang = name, LANGUAGES[name]
        if name == "php":
            source = php_only(source)
        self.t: Tokens = lex(source, self.lang.syntax)
        self.script, self.typed = self.lang is _SCRIPT, self.lang.typed
        self.control = CONTROL | MORE_CONTROL.get(name, set())
        self.access = ACCESS | {"->"} if name in ("c", "cpp", "php") else ACCESS
        self.symbols: list[dict] = []
        self.refs: list[dict] = []
        self.imports: list[dict] = []
        self.scopes: list[dict] = [{"idx": 0, "parent_idx": None, "range": self.t.whole()}]
        self.defs: list[dict] = []

    def facts(self) -> dict[str, list[dict]]:
        self.items(0, len(self.t), 0, None, "top", False)
        return {"symbols": self.symbols, "refs": self.refs, "imports": self.imports, "scopes": self.scopes, "scope_defs": self.defs}

    # what goes out

    def symbol(self, i: int, kind: str, first: int, last: int, owner: str | None, scope: int, mods: list[str], exported: bool, **more) -> int:
        name = self.t.word(i).strip("`")
        row = {"name": name, "kind": kind, "range": self.t.span(first, last), "name_range": self.t.span(i, i), "owner_type": owner, **more}
        if self.lang.marks_modifiers:
            row |= {"visibility": next((m for m in mods if m in VISIBILITIES), None), "is_static": "static" in mods or None, "is_abstract": "abstract" in mods or None}
        row["exported"] = name[:1].isupper() if self.id == "go" else exported
        if exported and "default" in mods and self.script:
            row["export_name"] = "default"
        self.symbols.append(row)
        self.defs.append({"scope_idx": scope, "name": name, "symbol": len(self.symbols) - 1})
        return len(self.symbols) - 1

    def local(self, scope: int, name: str) -> None:
        if name and name not in ("_", "this", "self"):
            self.defs.append({"scope_idx": scope, "name": name.strip("`"), "symbol": None})

    def scope(self, parent: int, first: int, last: int) -> int:
        self.scopes.append({"idx": len(self.scopes), "parent_idx": parent, "range": self.t.span(first, last)})
        return len(self.scopes) - 1

    def ref(self, i: int, role: str, receiver: str | None, args: int | None) -> None:
        self.refs.append({"name": self.t.word(i).strip("`"), "role": role, "range": self.t.span(i, i), "receiver": receiver, "arg_count": args})

    # declarations

    def items(self, i: int, end: int, scope: int, owner: str | None, inside: str, exported: bool) -> None:
        fresh = True
        while i < end:
            before = i
            i = max(self.item(i, end, scope, owner, inside, exported, fresh), i + 1)
            last = self.t.word(i - 1)
            fresh = last in {";", "{", "}", ":", "=>", "->"} or (last == ")" and self.t.text[before] in ("if", "for", "while", "foreach")) or (self.lang.lines and i < end and self.t.broken[i]) or last in {"else", "do"} or (last == ">" and self.t.text[before] == "template")

    def item(self, i: int, end: int, scope: int, owner: str | None, inside: str, exported: bool, fresh: bool) -> int:
        t, lang, first, mods = self.t, self.lang, i, []
        while i < end:
            w = t.text[i]
            if w == "@" and t.is_name(i + 1) and t.word(i + 1) != "interface" and fresh:
                i += 2
                while t.word(i) in (".", ":") and t.is_name(i + 1) and t.start[i] == t.end[i - 1]:
                    i += 2
                i = t.match[i] + 1 if t.word(i) == "(" and not (t.broken[i]) else i
            elif w == "#" and t.word(i + 1) in ("[", "!") and self.id in ("rust", "php"):
                i = t.match[i + 1 + (t.word(i + 1) == "!")] + 1
            elif w == "[" and fresh and self.id == "csharp" and inside != "code":
                i = t.match[i] + 1
            elif t.kind[i] == "name" and w in lang.modifiers and (t.is_name(i + 1) or t.word(i + 1) in ("(", "@", "{", "*", "[", "#", "~", "<")) and not (w not in ("pub", "export", "default") and t.word(i + 1) == "("):
                if w in ("export", "default") and t.word(i + 1) in ("{", "*") and not (w == "default"):
                    break
                mods.append(w)
                i += 1
                if w == "pub" and t.word(i) == "(":
                    i = t.match[i] + 1
                if w == "export":
                    exported, first = True, i
                    if t.word(i) == "default":
                        mods.append("default")
                        i, first = i + 1, i + 1
                fresh = True
            elif w == "*" and self.script and inside == "type" and (fresh or mods):
                i += 1
            elif w == "<" and mods and self.typed and t.angle(i) > i:  # type parameters before the type
                i = t.angle(i)
            elif w == "~" and inside == "type" and t.word(i + 2) == "(":  # a destructor
                i = t.match[i + 2] + 1
            else:
                break
        if i >= end:
            return i
        w, following = t.text[i], t.word(i + 1)
        if t.kind[i] == "name":
            if (out := self.special(i, end, scope, owner, inside, first)) is not None:
                return out
            if w in lang.types and following not in (".", "(", ",", ")", "=", ":", ";", "::", "?.") and (fresh or mods or self.script or inside == "code"):
                if (out := self.type_(i, end, scope, owner, inside, first, mods, exported)) is not None:
                    return out
            if w in lang.functions and t.word(i - 1) not in self.access:
                return self.function(i, end, scope, owner, inside, first, mods, exported)
            if w in lang.bindings and (t.is_name(i + 1) or following in OPENING):
                return self.binding(i, end, scope, owner, inside, first, mods, exported)
            if self.typed and (fresh or mods or t.word(i - 1) == "("):
                if (out := self.typed_declaration(i, end, scope, owner, inside, first, mods)) is not None:
                    return out
            if lang.bare_members and inside == "type" and (fresh or mods):
                if (out := self.member(i, end, scope, owner, first, mods, exported)) is not None:
                    return out
        return self.expression(i, end, scope, owner, exported)

    def special(self, i: int, end: int, scope: int, owner: str | None, inside: str, first: int) -> int | None:
        """Imports, and what only one language has."""
        t, w = self.t, self.t.text[i]
        if self.script and inside == "top" and w in ("import", "export") and t.word(i + 1) not in ("(", "."):
            return self.script_import(i, end)
        if self.id == "go":
            if w == "import" and inside == "top":
                return self.go_import(i)
            if w == "type" and (t.is_name(i + 1) or t.word(i + 1) == "("):
                return self.go_types(i, end, scope)
        if self.id == "java" and inside == "top" and w in ("import", "package"):
            return self.java_import(i, end, w)
        if w in ("package", "using", "use") and inside == "top" and self.id in ("kotlin", "scala", "csharp", "php", "rust") or w == "import" and inside == "top":
            return self.statement_end(i, end)
        if self.id == "php" and w == "namespace":
            return self.statement_end(i, end) if t.word(i + 1) != "{" else i + 1
        if self.id == "rust":
            if w == "impl" and inside != "code":
                return self.rust_impl(i, end, scope)
            if w == "macro_rules" and t.word(i + 1) == "!" and t.is_name(i + 2):
                close = t.match[i + 3] if t.word(i + 3) in OPENING else i + 2
                self.symbol(i + 2, "macro", first, close, owner, scope, [], False)
                return close + 1
        return None

    def statement_end(self, i: int, end: int) -> int:
        """Behind a statement: a semicolon, or a line break outside of brackets."""
        t, j = self.t, i + 1
        while j < end and t.text[j] != ";" and not (self.id in ("kotlin", "scala", "go") and t.broken[j]):
            if t.text[j] == "{" and self.id == "csharp":
                return j
            j = t.match[j] + 1 if t.text[j] in OPENING else j + 1
        return j + 1 if j < end and t.text[j] == ";" else j

    def type_(self, i: int, end: int, scope: int, owner: str | None, inside: str, first: int, mods: list[str], exported: bool) -> int | None:
        t, lang, word = self.t, self.lang, self.t.text[i]
        kind, at = lang.types[word], i + 1
        if t.word(at) in ("class", "struct", "record") and word in ("enum", "record", "case"):  # enum class, record struct
            at += 1
        named = t.is_name(at) and t.word(at) not in {w for w, _ in lang.heritage} and not (word == "module" and not t.is_name(at))
        if word == "enum" and self.id == "kotlin":
            return None
        if not named and not (self.script and word == "class" or word == "object" and t.word(at) in ("{", ":") or word in ("struct", "union", "enum", "namespace") and t.word(at) == "{"):
            return None
        j = at + named
        if kind == "module" and named:
            while t.word(j) in (".", "::") and t.is_name(j + 1):
                at, j = j + 1, j + 2
        name = t.word(at).strip("`") if named else owner
        j = t.angle(j)
        if self.id == "scala" and t.word(j) == "[":
            j = t.match[j] + 1
        if self.id == "scala":
            while t.word(j) in ("private", "protected"):
                j += 1
        if self.id == "kotlin":
            while t.word(j) in ("private", "protected", "internal", "public", "constructor") or t.word(j) == "@":
                j += 1
        params = []
        while t.word(j) == "(" and (self.id in ("kotlin", "scala", "csharp") or word == "record"):
            params.append(j)
            j = t.match[j] + 1
        found: list[tuple[int, str, str | None]] = []
        invoked: list[int] = []
        stop = None
        roles = dict(lang.heritage)
        while j < end:
            w = t.text[j]
            if w in ("{", ";", "}", ")", ",") or w == "=" or (lang.lines and t.broken[j] and w not in roles and w not in ("{", ",", "permits")):
                stop = j
                break
            if w in roles:
                j = self.bases(j + 1, end, roles[w], roles, found, invoked)
            elif w in OPENING:
                j = t.match[j] + 1
            else:
                j += 1
        body = stop if stop is not None and t.text[stop] == "{" else None
        if body is None and self.id in ("c", "cpp") or word in ("module", "namespace") and self.script and body is None:
            return None
        last = t.match[body] if body is not None else max(at, j - 1)
        if self.id == "csharp" and kind == "module" and body is None:  # a file-scoped namespace
            if named:
                self.symbol(at, kind, first, last, None, scope, mods, exported)
            return j + 1
        if word == "type" and self.id == "rust":
            last = max(at, self.statement_end(j, end) - 1)
        if named:
            self.symbol(at, kind, first, last, owner, scope, mods, exported)
        inner = self.scope(scope, first, last)
        for b, role, receiver in found:
            self.ref(b, role, receiver, None)
        for p in params:
            self.parameters(p, inner, name, exported if self.script else False)
        for p in invoked:
            self.items(p + 1, t.match[p], inner, name, "code", False)
        if body is None:
            return last + 1
        start = body + 1
        if kind == "module":
            self.items(start, last, inner, None, "top", exported)
            return last + 1
        if word in lang.closed_types:
            return last + 1
        if word == "enum" or "enum" in mods:
            while start < last and t.text[start] != ";":
                start = t.match[start] + 1 if t.text[start] in OPENING else start + 1
        self.items(start, last, inner, name, "type", exported)
        return last + 1

    def bases(self, j: int, end: int, role: str, stops: dict, found: list, invoked: list) -> int:
        """A list of supertypes: the last segment is the name, those before it the receiver; type arguments go. What is computed by
        a call isn't a supertype where bases can't be invoked; then it is read as an expression."""
        t = self.t
        while j < end:
            while t.word(j) in ("public", "private", "protected", "virtual", "@", "by"):
                j += 1
            if not t.is_name(j) and t.word(j) not in ("\\", "::"):
                return j
            if t.word(j) in ("\\", "::"):
                j += 1
            start = j
            while t.word(j + 1) in (".", "::", "\\") and t.is_name(j + 2):
                j += 2
            name, after = j, t.angle(j + 1)
            if self.id == "scala" and t.word(after) == "[":
                after = t.match[after] + 1
            receiver = t.source[t.start[start] : t.end[name - 2]] if name > start else None
            if t.word(after) == "(" and not self.lang.calls_bases:
                self.items(start, t.match[after] + 1, 0, None, "code", False)
                after = t.match[after] + 1
            else:
                found.append((name, role, receiver))
                while t.word(after) == "(":
                    invoked.append(after)
                    after = t.match[after] + 1
            if t.word(after) == "by":  # delegation
                after += 1
                while after < end and t.text[after] not in (",", "{") and not t.broken[after]:
                    after = t.match[after] + 1 if t.text[after] in OPENING else after + 1
            if t.word(after) != ",":
                return after
            j = after + 1
        return j

    def function(self, i: int, end: int, scope: int, owner: str | None, inside: str, first: int, mods: list[str], exported: bool) -> int:
        t, j, name, in_go = self.t, i + 1, None, None
        if t.word(j) in ("*", "&"):
            j += 1
        if self.id == "go" and t.word(j) == "(" and t.is_name(t.match[j] + 1) and t.word(t.match[j] + 2) in ("(", "["):
            in_go = j
            j = t.match[j] + 1
        if self.id == "kotlin":
            j = t.angle(j)
            while t.is_name(j) and t.word(t.angle(j + 1)) in (".", "?."):
                j = t.angle(j + 1) + 1
        if t.is_name(j):
            name, j = j, j + 1
        j = t.angle(j)
        if self.id in ("scala", "go") and t.word(j) == "[":
            j = t.match[j] + 1
        if t.word(j) != "(" and not (self.id == "scala" and name):
            return i + 1 if name is None else name
        if in_go is not None:
            names = [k for k in range(in_go, t.match[in_go]) if t.kind[k] == "name"]
            owner = t.word(names[1] if len(names) > 1 else names[0]) if names else None
        kind = self.lang.member if owner is not None and (inside == "type" or in_go is not None) else "function"
        return self.callable_(name, j, end, scope, owner, first, mods, exported, kind, in_go)

    def callable_(self, name: int | None, j: int, end: int, scope: int, owner: str | None, first: int, mods: list[str], exported: bool, kind: str | None, more_params: int | None = None) -> int:
        """From the parameter list at j to behind the body; kind None: no symbol."""
        t, lists = self.t, []
        while t.word(j) == "(" and (not lists or self.id == "scala" or self.id == "php"):
            lists.append(j)
            j = t.match[j] + 1
            if self.id == "php" and t.word(j) == "use":
                j += 1
        body, expression = None, False
        while j < end:
            w = t.text[j]
            if w == "{" and not (self.script and t.text[j - 1] in (":", "|", "&")) and not (self.id == "go" and t.text[j - 1] in ("struct", "interface")):
                body = j
                break
            if w in ("=", "=>") and (self.id in ("kotlin", "scala", "csharp") or w == "=>"):
                body, expression = j, True
                break
            if w in (";", "}", ")", ",") or w == "=" or (self.lang.lines and t.broken[j] and w not in (":", "->", "where", "|", "&")):
                break
            j = max(t.angle(j), t.match[j] + 1 if w in OPENING else j + 1)
        if body is None:
            last = max(j - 1, first)
            if t.word(j) == ";" and self.typed:
                last = j
        elif expression:
            last = self.expression_end(body + 1, end) - 1
        else:
            last = t.match[body]
        inner = self.scope(scope, first, last)
        count, variadic = 0, False
        for p in lists:
            n, v = self.parameters(p, inner, None, False)
            count, variadic = count + n, variadic or v
        if more_params is not None:
            self.parameters(more_params, inner, None, False)
        if kind is not None and name is not None and not (self.lang.needs_body and body is None):
            self.symbol(name, kind, first, last, owner, scope, mods, exported, param_count=count, variadic=variadic)
        if body is not None:
            self.items(body + 1, last + expression, inner, None if self.id == "go" else owner, "code", exported)
        return max(last + 1, j if body is None else 0)

    def expression_end(self, j: int, end: int) -> int:
        t, start = self.t, j
        while j < end:
            w = t.text[j]
            if w in (";", ",", ")", "]", "}"):
                return j
            if j > start and self.lang.lines and t.broken[j] and w not in (".", "?.", "+", "-", "*", "/", "&&", "||", "?", ":", "else", "catch", "==") and t.text[j - 1] not in ("=", "=>", "->", "+", "-", "*", "&&", "||", "(", ",", "?", ":", "else"):
                return j
            j = t.match[j] + 1 if w in OPENING else j + 1
        return j

    def parameters(self, p: int, scope: int, owner: str | None, exported: bool) -> tuple[int, bool]:
        """Number of parameters and whether it may grow, of the list at p; names are locals, or with ``owner`` properties where
        they are marked as such."""
        t, variadic, pieces = self.t, False, []
        j, end, start = p + 1, t.match[p], p + 1
        while j <= end:
            if j == end or t.text[j] == ",":
                if j > start:
                    pieces.append((start, j))
                start = j + 1
                j += 1
            else:
                j = max(t.angle(j), t.match[j] + 1 if t.text[j] in OPENING else j + 1)
        if self.id == "go" and any(b - a > 1 for a, b in pieces):
            count = sum(b - a > 1 for a, b in pieces)
        else:
            count = len(pieces)
        for a, b in pieces:
            words = t.text[a:b]
            variadic = variadic or "..." in words or (self.id == "kotlin" and "vararg" in words) or (self.id == "csharp" and words[0] == "params") or (self.id == "scala" and words[-1] == "*")
            stop = next((k for k in range(a, b) if t.text[k] == "="), b)
            if self.typed:
                names = [k for k in range(a, stop) if t.kind[k] == "name"]
                names = names[-1:] if len(names) > 1 or self.id == "csharp" else []
            elif self.id == "php":
                names = [k for k in range(a, stop) if t.text[k].startswith("$")][:1]
            else:
                stop = next((k for k in range(a, stop) if t.text[k] in (":", "?") and t.kind[k] == "mark"), stop)
                if self.id == "go":
                    stop = min(stop, a + 1)
                names = [k for k in range(a, stop) if t.kind[k] == "name" and t.text[k] not in ("mut", "ref", "vararg", "crossinline", "noinline", "implicit", "using", *self.lang.modifiers, *self.lang.bindings)]
                if t.text[a] not in OPENING and "..." not in words:
                    names = names[:1] if not self.script else names[-1:]
            for k in names:
                if owner is not None and any(m in self.lang.bindings for m in words):
                    self.symbol(k, self.lang.property_kind or "property", a, b - 1, owner, scope, [], exported)
                else:
                    self.local(scope, t.text[k])
            if stop < b:  # a default value, or a type that may hold a literal
                self.items(next((k + 1 for k in range(a, b) if t.text[k] == "="), b), b, scope, None, "code", False)
        return count, variadic

    def binding(self, i: int, end: int, scope: int, owner: str | None, inside: str, first: int, mods: list[str], exported: bool) -> int:
        t, j = self.t, i + 1
        if self.id == "go" and t.word(j) == "(":
            for k in range(j + 1, t.match[j]):
                if t.kind[k] == "name" and (t.broken[k] or k == j + 1):
                    self.local(scope, t.text[k])
            return j + 1
        if self.id == "kotlin":
            j = t.angle(j)
        if self.id == "rust":
            while t.word(j) in ("mut", "ref"):
                j += 1
        if t.word(j) in OPENING:
            for k in range(j + 1, t.match[j]):
                if t.kind[k] == "name" and t.word(k + 1) != ":" and t.word(k - 1) != "=":
                    self.local(scope, t.text[k])
            return t.match[j] + 1
        name = j
        if self.id == "kotlin":
            while t.word(t.angle(j + 1)) == "." and t.is_name(t.angle(j + 1) + 1):
                j = name = t.angle(j + 1) + 1
        value = self.value_at(j + 1, end)
        if self.script and value is not None:
            v = value + (t.word(value) == "async")
            arrow = self.arrow(v, end)
            if arrow is not None or t.word(v) == "function":
                if arrow is not None:
                    return self.arrow_function(v, arrow, end, scope, owner, exported, (name, first, mods))
                at = v + 1 + (t.word(v + 1) == "*")
                at += t.is_name(at)
                return self.callable_(name, t.angle(at), end, scope, owner if inside == "type" else None, first, mods, exported, "function")
            if t.word(v) == "class":
                return v
        if self.lang.property_kind and inside != "code":
            last = self.expression_end(j + 1, end) - 1
            self.symbol(name, self.lang.property_kind, first, max(last, name), owner, scope, mods, exported)
        elif self.id == "go":
            while t.is_name(name):
                self.local(scope, t.text[name])
                if t.word(name + 1) != ",":
                    break
                name += 2
            return name + 1
        else:
            self.local(scope, t.text[name])
        return name + 1

    def value_at(self, j: int, end: int) -> int | None:
        """Behind the = of a binding whose type, if any, begins at j."""
        t = self.t
        while j < end and t.text[j] not in ("=", ";", ",", ")", "}", "in", "of"):
            if t.broken[j] and self.lang.lines and t.text[j] not in ("|", "&", ":"):
                return None
            j = max(t.angle(j), t.match[j] + 1 if t.text[j] in OPENING else j + 1)
        return j + 1 if j < end and t.text[j] == "=" else None

    def member(self, i: int, end: int, scope: int, owner: str | None, first: int, mods: list[str], exported: bool) -> int | None:
        """ECMAScript: a method or a method's signature, or a field that holds a function."""
        t = self.t
        j = i + 1 + (t.word(i + 1) == "?")
        after = t.angle(j)
        if t.word(after) == "(":
            return self.callable_(i, after, end, scope, owner, first, mods, exported, "method")
        value = self.value_at(j, end) if t.word(j) in ("=", ":", "!") else None
        if value is not None:
            v = value + (t.word(value) == "async")
            if (arrow := self.arrow(v, end)) is not None:
                return self.arrow_function(v, arrow, end, scope, owner, exported, None)
            return value
        if t.word(j) in (":", ";", "!"):
            return self.expression_end(j + 1, end)
        return None

    def typed_declaration(self, i: int, end: int, scope: int, owner: str | None, inside: str, first: int, mods: list[str]) -> int | None:
        """Type before name: functions, methods, constructors, properties, fields, locals."""
        t = self.t
        if t.text[i] in self.control - {"default"} or t.text[i] in ("goto", "break", "continue", "typedef", "template", "operator"):
            if t.text[i] == "template":
                return t.angle(i + 1)
            return None
        if self.id == "c" and t.text[i] in ("struct", "union", "enum") or self.id == "cpp" and t.text[i] in ("struct", "class", "enum"):
            i += 1
        constructor = inside == "type" and t.text[i] == owner and t.word(i + 1) == "("
        j = i
        if not constructor:
            j = self.type_end(i)
            if j is None or j >= end:
                return None
        qualifier = None
        while t.is_name(j) and t.word(t.angle(j + 1)) == "::" and t.is_name(t.angle(j + 1) + 1) and self.id == "cpp":
            qualifier, j = t.text[j], t.angle(j + 1) + 1
        if self.id == "cpp" and not constructor and j == i:
            return None
        if self.id == "csharp" and t.is_name(j) and t.word(t.angle(j + 1)) == "." and inside == "type":  # an explicit interface member
            j = t.angle(j + 1) + 1
        if not t.is_name(j) or t.text[j] in self.control - {"get", "set", "init", "default"}:
            return None
        after = t.angle(j + 1)
        if t.word(after) == "(":
            close = t.match[after] + 1
            while t.is_name(close) and t.text[close] in ("throws", "const", "override", "noexcept", "final", "volatile", "where", "mutable") or t.word(close) in (".", ",", "&") and t.text[close - 1] != ")":
                close += 1
                while t.is_name(close) and t.text[close] not in ("where", "override", "final", "const", "noexcept"):
                    close = t.angle(close + 1)
            ends = t.word(close)
            if t.is_name(close) or ends == "->":
                ends = "{" if any(t.word(k) == "{" for k in range(close, min(close + 12, end))) else ends
            definition = ends == "{" or (ends == "=>" and self.id == "csharp") or (ends == ":" and self.id in ("cpp", "csharp") and (constructor or qualifier == t.text[j]))
            if not definition and not (ends in (";", "=") and inside != "code"):
                return None
            own = qualifier or (owner if inside == "type" else None)
            if constructor and self.id in ("java", "csharp"):
                kind = None
            else:
                kind = self.lang.member if own is not None and not constructor else "function"
            if ends == ":":  # initialisers before the body
                k = close + 1
                while k < end and t.text[k] != "{":
                    k = t.match[k] + 1 if t.text[k] in OPENING and t.text[k] != "{" else k + 1
                    if k < end and t.text[k] == "{" and t.is_name(k - 1):
                        k = t.match[k] + 1
                if k < end:
                    inner = self.scope(scope, first, t.match[k])
                    n, v = self.parameters(after, inner, None, False)
                    if kind:
                        self.symbol(j, kind, first, t.match[k], own, scope, mods, False, param_count=n, variadic=v)
                    for p in range(close + 1, k):
                        if t.text[p] in ("(", "{") and t.match[p] > p:
                            self.items(p + 1, t.match[p], inner, own, "code", False)
                    self.items(k + 1, t.match[k], inner, own, "code", False)
                    return t.match[k] + 1
            return self.callable_(j, after, end, scope, own, first, mods, False, kind)
        if constructor:
            return None
        if self.id == "csharp" and inside == "type" and t.word(j + 1) in ("{", "=>"):
            last = t.match[j + 1] if t.word(j + 1) == "{" else self.expression_end(j + 2, end)
            self.symbol(j, "property", first, last, owner, scope, mods, False)
            self.items(j + 2, last, scope, owner, "code", False)
            return last + 1
        if t.word(j + 1) in ("=", ";", ",", ":", "[", ")", "in") and not (t.word(j + 1) == ")" and t.word(i - 1) != "("):
            self.local(scope, t.text[j])
            k = j + 1
            while t.word(k) == "," and t.is_name(k + 1) and t.word(k + 2) in ("=", ",", ";"):
                self.local(scope, t.text[k + 1])
                k += 2
            return j + 1
        return None

    def type_end(self, i: int) -> int | None:
        """Behind a type that begins at i: qualified names, type arguments, arrays, pointers; None where it can't be one."""
        t, j, words = self.t, i, 0
        while t.is_name(j):
            w = t.text[j]
            if words and not (w in ("const", "unsigned", "signed", "long", "int", "short", "char", "double", "volatile", "restrict") or t.text[j - 1] in ("const", "unsigned", "signed", "long", "short", "struct", "volatile", "final", "constexpr")):
                break
            words += 1
            j += 1
            while t.word(j) in (".", "::") and t.is_name(j + 1):
                if t.word(j) == "::" and t.word(t.angle(j + 2)) == "(":  # a constructor outside of its class
                    return j - 1 if words == 1 else j
                j += 2
            j = t.angle(j)
            while t.word(j) == "::" and t.is_name(j + 1):
                j = t.angle(j + 2)
        if not words:
            return None
        while t.word(j) in ("*", "&", "?", "&&") or t.word(j) == "[" and t.match[j] == j + 1 or t.word(j) == "const":
            j = t.match[j] + 1 if t.text[j] == "[" else j + 1
        return j

    # expressions

    def expression(self, i: int, end: int, scope: int, owner: str | None, exported: bool) -> int:
        t, w = self.t, self.t.text[i]
        if t.kind[i] == "name":
            return self.name(i, end, scope, owner)
        if w == "(" and (arrow := self.arrow(i, end)) is not None:
            return self.arrow_function(i, arrow, end, scope, owner, exported, None)
        if w == "|" and self.id == "rust" and t.text[i - 1] in ("(", ",", "=", "move", "{", ";", "=>", "return") and (close := next((k for k in range(i + 1, min(end, i + 40)) if t.text[k] == "|"), None)):
            inner = self.scope(scope, i, max(close, self.expression_end(close + 1, end) - 1))
            for k in range(i + 1, close):
                if t.kind[k] == "name" and t.text[k - 1] in ("|", ",", "mut", "(", "&"):
                    self.local(inner, t.text[k])
            stop = self.expression_end(close + 1, end)
            self.items(close + 1, stop, inner, owner, "code", exported)
            return stop
        if w == "{":
            return self.block(i, scope, owner, exported)
        if w == ":=":
            k = i - 1
            while k >= 0 and t.kind[k] == "name":
                self.local(scope, t.text[k])
                if t.word(k - 1) != ",":
                    break
                k -= 2
        elif w == "<-" and self.id == "scala" and t.is_name(i - 1):
            self.local(scope, t.text[i - 1])
        return i + 1

    def block(self, i: int, scope: int, owner: str | None, exported: bool) -> int:
        t, last = self.t, self.t.match[i]
        inner, start = self.scope(scope, i, last), i + 1
        if self.id in ("kotlin", "scala"):  # a lambda's parameters
            j = start
            while j < last and (t.kind[j] == "name" or t.text[j] in (",", ":", "(", ")", ".", "?", "<", ">")) and not t.broken[j] | (t.text[j] == "case"):
                j += 1
            if t.word(j) in ("->", "=>") and j > start and t.text[start] != "case":
                for k in range(start, j):
                    if t.kind[k] == "name" and t.text[k - 1] in ("{", ",", "("):
                        self.local(inner, t.text[k])
                start = j + 1
        self.items(start, last, inner, owner, "code", exported)
        return last + 1

    def arrow(self, i: int, end: int) -> int | None:
        """The place of the arrow of a function literal that begins at i."""
        t = self.t
        marks = ("->",) if self.id == "java" else ("=>",) if self.script or self.id in ("csharp", "scala") else ()
        if not marks or i >= end:
            return None
        if t.kind[i] == "name":
            return i + 1 if t.word(i + 1) in marks and t.text[i] not in self.control else None
        i = t.angle(i)
        if t.word(i) != "(":
            return None
        j = t.match[i] + 1
        if t.word(j) == ":" and self.script and t.word(i - 1) != "?":
            j += 1
            for _ in range(12):
                if t.word(j) in ("=>", ",", ";", ")", "=", "") or t.word(j) == "{" and t.text[j - 1] != ":":
                    break
                j = max(t.angle(j), t.match[j] + 1 if t.word(j) in OPENING else j + 1)
        return j if t.word(j) in marks and j < end else None

    def arrow_function(self, i: int, arrow: int, end: int, scope: int, owner: str | None, exported: bool, named: tuple | None) -> int:
        t = self.t
        stop = t.match[arrow + 1] + 1 if t.word(arrow + 1) == "{" else self.expression_end(arrow + 1, end)
        stop = max(stop, arrow + 1)
        first = named[1] if named else i
        inner, count, variadic = self.scope(scope, i, stop - 1), 1, False
        if t.kind[i] == "name":
            self.local(inner, t.text[i])
        else:
            count, variadic = self.parameters(t.angle(i), inner, None, False)
        if named:
            self.symbol(named[0], "function", first, stop - 1, None, scope, named[2], exported, param_count=count, variadic=variadic)
        self.items(arrow + 1 + (t.word(arrow + 1) == "{"), stop - (t.word(arrow + 1) == "{"), inner, owner, "code", exported)
        return stop

    def name(self, i: int, end: int, scope: int, owner: str | None) -> int:
        t, w = self.t, self.t.text[i]
        if self.arrow(i, end) == i + 1:
            return self.arrow_function(i, i + 1, end, scope, owner, False, None)
        if w in ("catch", "for", "foreach") and t.word(i + 1) == "(":
            p, close = i + 1, t.match[i + 1]
            if self.id == "kotlin" or (self.script and w == "catch"):
                for k in range(p + 1, close):
                    if t.text[k] in (":", "in") and t.kind[k] in ("mark", "name"):
                        break
                    if t.kind[k] == "name" and t.text[k] not in ("in", "val"):
                        self.local(scope, t.text[k])
            elif self.id == "php":
                for k in range(p + 1, close):
                    if t.text[k].startswith("$") and (w == "catch" or t.text[k - 1] in ("as", ">", "=>", "&")):
                        self.local(scope, t.text[k])
            return i + 1
        if w == "for" and self.id == "rust":
            k = i + 1
            while k < end and t.text[k] not in ("in", "{", "<"):
                if t.kind[k] == "name":
                    self.local(scope, t.text[k])
                k += 1
            return k
        if self.id == "php" and w.startswith("$"):
            if t.word(i + 1) == "=" and t.word(i - 1) not in self.access:
                self.local(scope, w)
            return i + 1
        made = t.word(i - 1) == "new" or (t.word(i - 1) in (".", "\\") and self.made(i))
        after = t.angle(i + 1)
        if self.id == "rust":
            if t.word(i + 1) == "!" and t.word(i + 2) in OPENING:
                self.ref(i, "call", None, self.arguments(i + 2))
                return i + 2
            if t.word(i + 1) == "::" and t.word(i + 2) == "<":
                after = t.angle(i + 2)
        if self.id == "scala" and t.word(after) == "[" and t.word(t.match[after] + 1) == "(":
            after = t.match[after] + 1
        if made and not (t.word(i + 1) in (".", "\\") and t.is_name(i + 2)):
            self.ref(i, "call", self.receiver(i, True), self.arguments(after) if t.word(after) == "(" else 0)
            return i + 1
        if w in self.control and t.word(i - 1) not in self.access:
            return i + 1
        if t.word(after) == "(" and not (self.lang.lines and t.broken[after]):
            self.ref(i, "call", self.receiver(i, False), self.arguments(after))
        elif t.word(after) == "{" and self.id == "kotlin" and not t.broken[after] and t.word(i - 1) not in ("is", ":", "as", "in", "else"):
            self.ref(i, "call", self.receiver(i, False), 0)
        return i + 1

    def made(self, i: int) -> bool:
        """Whether a qualified name is what ``new`` makes."""
        t = self.t
        while t.word(i - 1) in (".", "\\") and (t.is_name(i - 2) or t.word(i - 1) == "\\"):
            i -= 2 if t.is_name(i - 2) else 1
        return t.word(i - 1) == "new"

    def arguments(self, p: int) -> int:
        t, n, j, end = self.t, 0, p + 1, self.t.match[p]
        if j >= end:
            return 0
        while j < end:
            n += t.text[j] == ","
            j = max(t.angle(j) if t.kind[j - 1] == "name" else j, t.match[j] + 1 if t.text[j] in OPENING else j + 1)
        return n + (t.text[end - 1] != ",")

    def receiver(self, i: int, made: bool) -> str | None:
        """The text before the last access mark."""
        t = self.t
        if t.word(i - 1) not in self.access and not (t.word(i - 1) == "\\" and made):
            return None
        j = i - 2
        while j >= 0:
            if t.text[j] in (")", "]") and t.match[j] < j:
                j = t.match[j] - 1
                if j >= 0 and t.kind[j] != "name":
                    break
                continue
            if t.kind[j] not in ("name", "string"):
                j += 1
                break
            if t.word(j - 1) not in self.access:
                break
            j -= 2
        j = max(j, 0)
        text = t.source[t.start[j] : t.end[i - 2]].strip()
        return text or None

    # imports

    def script_import(self, i: int, end: int) -> int:
        t, w = self.t, self.t.text[i]
        if w == "export" and t.word(i + 1) not in ("{", "*") and not (t.word(i + 1) == "type" and t.word(i + 2) in ("{", "*")):
            return i + 1
        j = i + 1
        while j < end and t.kind[j] != "string" and t.text[j] != ";":
            if j > i + 1 and t.broken[j] and t.text[j] != "from" and t.text[j - 1] not in ("from", ","):
                break
            j = t.match[j] + 1 if t.text[j] in OPENING else j + 1
        if j >= end or t.kind[j] != "string":
            return j
        source, k, star = t.text[j][1:-1], i + 1, True
        if t.word(k) == "type" and t.word(k + 1) not in ("from", ","):
            k += 1
        put = lambda kind, imported, local: self.imports.append({"source": source, "kind": kind, "imported_name": imported, "local_name": local})
        if w == "import" and k == j:
            put("side-effect", None, None)
        while k < j and t.text[k] != "from":
            if t.text[k] == "{":
                for a, b in self.specifiers(k):
                    star = False
                    put("named" if w == "import" else "reexport", a, b)
                k = t.match[k]
            elif t.text[k] == "*":
                named = t.word(k + 1) == "as" and t.is_name(k + 2)
                if w == "import" and named:
                    put("namespace", None, t.text[k + 2])
                k += 2 * named
            elif t.kind[k] == "name" and w == "import":
                put("default", "default", t.text[k])
            k += 1
        if w == "export" and star:
            put("reexport-star", None, None)
        return j + 1

    def specifiers(self, p: int):
        """(imported, local) names of a list in braces."""
        t, j, end = self.t, p + 1, self.t.match[p]
        while j < end:
            if t.word(j) == "type" and (t.is_name(j + 1) and t.word(j + 1) != "as" or t.kind[j + 1] == "string"):
                j += 1
            name = t.text[j].strip("'\"")
            if t.word(j + 1) == "as" and j + 2 < end:
                yield name, t.text[j + 2].strip("'\"")
                j += 2
            else:
                yield name, name
            while j < end and t.text[j] != ",":
                j += 1
            j += 1

    def go_import(self, i: int) -> int:
        t = self.t
        stop = t.match[i + 1] if t.word(i + 1) == "(" else next((k for k in range(i + 1, len(t)) if t.kind[k] == "string"), i)
        for k in range(i + 1, stop + 1):
            if t.kind[k] == "string":
                source, alias = t.text[k][1:-1], t.text[k - 1] if not t.broken[k] and k - 1 > i and (t.kind[k - 1] == "name" or t.text[k - 1] == ".") else None
                kind = {"_": "side-effect", ".": "wildcard"}.get(alias or "", "namespace")
                self.imports.append({"source": source, "kind": kind, "imported_name": None, "local_name": (alias or source.rpartition("/")[2]) if kind == "namespace" else None})
        return stop + 1

    def go_types(self, i: int, end: int, scope: int) -> int:
        t = self.t
        group = t.word(i + 1) == "("
        j, stop = (i + 2, t.match[i + 1]) if group else (i + 1, end)
        while j < stop and t.is_name(j):
            name, first = j, j if group else i
            k = j + 1
            if t.word(k) == "[" and t.match[k] > k + 1 and t.kind[k + 1] == "name" and t.word(k + 2) != "]":
                k = t.match[k] + 1
            kind = "interface" if t.word(k) == "interface" else "type"
            last = self.expression_end(k, stop) - 1
            self.symbol(name, kind, first, max(last, name), None, scope, [], False)
            j = last + 1
            if not group:
                return j
        return stop + 1 if group else j

    def java_import(self, i: int, end: int, word: str) -> int:
        t, j = self.t, i + 1
        static = t.word(j) == "static"
        j += static
        parts = []
        while j < end and t.text[j] != ";":
            if t.kind[j] == "name" or t.text[j] == "*":
                parts.append(t.text[j])
            j += 1
        if word == "import" and parts:
            more = {"is_static": True} if static else {}
            if parts[-1] == "*":
                self.imports.append({"source": ".".join(parts[:-1]), "kind": "wildcard", "imported_name": None, "local_name": None, **more})
            else:
                self.imports.append({"source": ".".join(parts[:-1]), "kind": "named", "imported_name": parts[-1], "local_name": parts[-1], **more})
        return j + 1

    def rust_impl(self, i: int, end: int, scope: int) -> int:
        t = self.t
        j = t.angle(i + 1)
        name = None
        while j < end and t.text[j] not in ("{", ";"):
            if t.text[j] == "for":
                name = None
            elif t.text[j] == "where":
                j = next((k for k in range(j, end) if t.text[k] == "{"), end)
                break
            elif t.kind[j] == "name" and t.text[j] not in ("dyn", "mut", "const"):
                name = t.text[j]
            j = max(t.angle(j + 1), j + 1)
        if t.word(j) != "{":
            return j + 1
        inner = self.scope(scope, i, t.match[j])
        self.items(j + 1, t.match[j], inner, name, "type", False)
        return t.match[j] + 1


def php_only(source: str) -> str:
    """The text with everything outside of <?php ... ?> blanked, so that places stay."""
    out, at = [], 0
    blank = lambda s: "".join(c if c == "\n" else " " for c in s)
    while (start := source.find("<?", at)) >= 0:
        head = start + (5 if source.startswith("<?php", start) else 3 if source.startswith("<?=", start) else 2)
        stop = source.find("?>", head)
        stop = len(source) if stop < 0 else stop
        out += [blank(source[at:head]), source[head:stop]]
        at = stop
        if stop < len(source):
            out.append("; ")
            at = stop + 2
    return "".join(out) + blank(source[at:])


def parse(name: str, source: str) -> dict[str, list[dict]]:
    return Front(name, source).facts()
