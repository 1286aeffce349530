"""Python source to facts, by the standard library's syntax tree. Columns are UTF-16 code units, lines count from 1."""

from __future__ import annotations

import ast


class _Columns:
    """UTF-8 byte columns of the syntax tree to UTF-16 columns."""

    def __init__(self, source: str) -> None:
        self.lines = [line.encode() for line in source.split("\n")]

    def at(self, line: int, col: int) -> tuple[int, int]:
        raw = self.lines[line - 1] if line <= len(self.lines) else b""
        return line, len(raw[:col].decode(errors="replace").encode("utf-16-le")) // 2

    def span(self, node: ast.AST) -> tuple[int, int, int, int]:
        return (*self.at(node.lineno, node.col_offset), *self.at(node.end_lineno, node.end_col_offset))

    def find(self, line: int, col: int, name: str) -> tuple[int, int, int, int]:
        """The first place of a name from a byte place on."""
        want = name.encode()
        while line <= len(self.lines):
            at = self.lines[line - 1].find(want, col)
            if at >= 0:
                return (*self.at(line, at), *self.at(line, at + len(want)))
            line, col = line + 1, 0
        return (line, 0, line, 0)


def visibility(name: str) -> str | None:
    """By the leading underscores; a name with two at both ends counts as one with one."""
    if name.startswith("__") and not name.endswith("__"):
        return "private"
    return "protected" if name.startswith("_") else None


def _params(args: ast.arguments) -> tuple[int, bool]:
    """Every entry of the list counts: self, the marks / and *, and the ones that collect the rest."""
    n = len(args.posonlyargs) + bool(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) + bool(args.kwonlyargs and not args.vararg)
    return n + bool(args.vararg) + bool(args.kwarg), bool(args.vararg or args.kwarg)


def parse(source: str) -> dict[str, list[dict]] | None:
    """Facts of one file, or None where it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    c = _Columns(source)
    out: dict[str, list[dict]] = {"symbols": [], "refs": [], "imports": [], "scopes": [], "scope_defs": []}
    last = len(c.lines)
    out["scopes"].append({"idx": 0, "parent_idx": None, "range": (1, 0, last, len(c.lines[-1].decode(errors="replace").encode("utf-16-le")) // 2)})

    def text(node: ast.AST) -> str | None:
        return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else None

    def local(scope: int, name: str) -> None:
        out["scope_defs"].append({"scope_idx": scope, "name": name, "symbol": None})

    def symbol(node, name: str, kind: str, where: tuple, owner: str | None, scope: int, **more) -> None:
        out["symbols"].append({"name": name, "kind": kind, "range": c.span(node), "name_range": where, "owner_type": owner, "visibility": visibility(name), **more})
        out["scope_defs"].append({"scope_idx": scope, "name": name, "symbol": len(out["symbols"]) - 1})

    def ref(node: ast.AST, role: str, args: int | None = None) -> None:
        if isinstance(node, ast.Name):
            out["refs"].append({"name": node.id, "role": role, "range": c.span(node), "receiver": None, "arg_count": args})
        elif isinstance(node, ast.Attribute):
            receiver = ast.unparse(node.value)
            line, col = node.end_lineno, node.end_col_offset - len(node.attr.encode())
            out["refs"].append({"name": node.attr, "role": role, "range": (*c.at(line, col), *c.at(node.end_lineno, node.end_col_offset)), "receiver": receiver, "arg_count": args})

    def scope_for(node: ast.AST, parent: int) -> int:
        out["scopes"].append({"idx": len(out["scopes"]), "parent_idx": parent, "range": c.span(node)})
        return len(out["scopes"]) - 1

    def targets(node: ast.AST):
        if isinstance(node, ast.Name):
            yield node
        elif isinstance(node, (ast.Tuple, ast.List)):
            for e in node.elts:
                yield from targets(e)
        elif isinstance(node, ast.Starred):
            yield from targets(node.value)

    def walk(node: ast.AST, scope: int, owner: str | None, top: bool) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            n, variadic = _params(node.args)
            marks = {text(d) for d in node.decorator_list}
            where = c.find(node.lineno, node.col_offset + 3, node.name)
            symbol(
                node, node.name, "function", where, owner, scope, param_count=n, variadic=variadic,
                is_static="staticmethod" in marks or None, is_abstract="abstractmethod" in marks or None,
            )
            for e in [*node.decorator_list, *node.args.defaults, *[d for d in node.args.kw_defaults if d]]:
                walk(e, scope, owner, False)
            inner = scope_for(node, scope)
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]:
                local(inner, a.arg)
            for s in node.body:
                walk(s, inner, None, False)
        elif isinstance(node, ast.ClassDef):
            symbol(node, node.name, "class", c.find(node.lineno, node.col_offset + 5, node.name), owner, scope)
            for d in node.decorator_list:
                walk(d, scope, owner, False)
            for b in node.bases:
                base = b.value if isinstance(b, ast.Subscript) else b
                ref(base, "extends")
            inner = scope_for(node, scope)
            for s in node.body:
                walk(s, inner, node.name, False)
        elif isinstance(node, ast.Import):
            for a in node.names:
                out["imports"].append({"source": a.name, "kind": "namespace", "imported_name": None, "local_name": a.asname or a.name.partition(".")[0]})
        elif isinstance(node, ast.ImportFrom):
            source = "." * node.level + (node.module or "")
            for a in node.names:
                kind = "wildcard" if a.name == "*" else "named"
                out["imports"].append({"source": source, "kind": kind, "imported_name": None if kind == "wildcard" else a.name, "local_name": None if kind == "wildcard" else a.asname or a.name})
        elif isinstance(node, ast.Lambda):
            inner = scope_for(node, scope)
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                local(inner, a.arg)
            walk(node.body, inner, None, False)
        elif isinstance(node, ast.Call):
            ref(node.func, "call", len(node.args) + len(node.keywords))
            walk(node.func.value if isinstance(node.func, ast.Attribute) else ast.Pass(), scope, owner, False)
            if not isinstance(node.func, (ast.Name, ast.Attribute)):
                walk(node.func, scope, owner, False)
            for a in [*node.args, *[k.value for k in node.keywords]]:
                walk(a, scope, owner, False)
        else:
            found = [t for target in (node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.For, ast.AsyncFor, ast.NamedExpr, ast.comprehension)) else []) for t in targets(target)]
            found += [t for i in getattr(node, "items", []) if isinstance(i, ast.withitem) and i.optional_vars for t in targets(i.optional_vars)]
            for t in found:
                if top and isinstance(node, ast.Assign):
                    symbol(t, t.id, "constant", c.span(t), owner, scope)
                else:
                    local(scope, t.id)
            if isinstance(node, ast.ExceptHandler) and node.name:
                local(scope, node.name)
            for child in ast.iter_child_nodes(node):
                walk(child, scope, owner, False)

    for statement in tree.body:
        walk(statement, 0, None, True)
    return out
