"""Ignore-file rules: nested files, deeper ones win, negation, no way back into an ignored directory."""

from __future__ import annotations

import re


def pattern(line: str) -> tuple[bool, bool, re.Pattern] | None:
    """(negated, directories only, regex over a path relative to the rule file's directory), or None for a blank or comment."""
    line = line.rstrip("\n").rstrip("\r")
    if line.endswith(" ") and not line.endswith("\\ "):
        line = line.rstrip(" ")
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    if line[:2] in ("\\!", "\\#"):
        line = line[1:]
    dirs = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    return negated, dirs, re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z", re.S)


class Rules:
    """All ignore files of a tree: directory (empty: root) to text."""

    def __init__(self, files: dict[str, str]) -> None:
        self.rules = {d: [p for p in map(pattern, t.splitlines()) if p] for d, t in files.items()}

    def _one(self, path: str, is_dir: bool) -> bool:
        parts = path.split("/")
        for k in range(len(parts) - 1, -1, -1):  # from the deepest rule file up
            base = "/".join(parts[:k])
            for negated, dirs, regex in reversed(self.rules.get(base, ())):
                if (is_dir or not dirs) and regex.match("/".join(parts[k:])):
                    return not negated
        return False

    def ignores(self, path: str, is_dir: bool = False) -> bool:
        """Whether a file or directory, or a directory above it, is ignored."""
        parts = path.split("/")
        return any(self._one("/".join(parts[:k]), k < len(parts) or is_dir) for k in range(1, len(parts) + 1))
