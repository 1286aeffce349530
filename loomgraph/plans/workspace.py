"""Several repositories below a folder: finding them, choosing among them, asking and syncing each."""

from __future__ import annotations

import itertools
import os
import re
import threading
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass
from queue import PriorityQueue

from pyspark.sql import SparkSession

from ..functions.paths import PRUNED
from ..operators import render
from ..schemas import Index
from .store import Store

#: Files that mark a project outside of any repository, how deep is looked, and how many are asked at once.
MARKERS = ("package.json", "pyproject.toml", "setup.py", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "Gemfile", "CMakeLists.txt", "tsconfig.json")
MOST_DEPTH, FANOUT = 4, 8
WORKERS, TYPED_WORKERS = 2, 1


@dataclass(frozen=True)
class Repo:
    path: str
    name: str
    kind: str  # git or marker
    worktree_of: str | None = None


def is_git(folder: str) -> bool:
    return os.path.lexists(os.path.join(folder, ".git"))


def main_root(folder: str) -> str | None:
    """The repository that a linked worktree belongs to: its .git is a file that points below the repository's worktrees."""
    pointer = os.path.join(folder, ".git")
    if not os.path.isfile(pointer):
        return None
    with open(pointer, encoding="utf-8", errors="replace") as f:
        found = re.search(r"(?m)^gitdir:\s*(.+?)\s*$", f.read())
    if not found:
        return None
    target = os.path.normpath(os.path.join(folder, found[1]))
    head, mark, _ = target.partition(f"{os.sep}.git{os.sep}worktrees{os.sep}")
    return head if mark else None


def inside(folder: str, path: str) -> bool:
    return path == folder or path.startswith(folder.rstrip(os.sep) + os.sep)


def discover(root: str) -> list[Repo]:
    """The repositories at or below a folder, and marked projects outside of any, by path; a linked worktree counts with its
    repository."""
    root = os.path.abspath(root)
    name = os.path.basename
    if is_git(root):
        return [Repo(root, name(root), "git")]
    found: list[Repo] = []

    def visit(folder: str, depth: int, within: bool) -> None:
        git = folder != root and is_git(folder)
        if git:
            found.append(Repo(folder, name(folder), "git", main_root(folder)))
        elif folder != root and not within and any(os.path.isfile(os.path.join(folder, m)) for m in MARKERS):
            found.append(Repo(folder, name(folder), "marker"))
        if depth == MOST_DEPTH:
            return
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            if not e.name.startswith(".") and e.name not in PRUNED and e.is_dir(follow_symlinks=False):
                visit(e.path, depth + 1, within or git)

    visit(root, 0, False)
    roots = [r.path for r in found if r.kind == "git"]
    kept: dict[str, Repo] = {}
    for r in found:
        if r.kind == "git" or not any(inside(g, r.path) for g in roots):
            kept.setdefault(r.worktree_of or r.path, r)
    return sorted(kept.values(), key=lambda r: (r.path.casefold(), r.path))


def enclosing(folder: str) -> str | None:
    """The repository that a folder is in."""
    here = os.path.abspath(folder)
    while True:
        if is_git(here):
            return here
        up = os.path.dirname(here)
        if up == here:
            return None
        here = up


def repos_of(cwd: str) -> list[Repo]:
    """Of the folder one works in: its repository, else what is below, else the folder itself; the ones around it first."""
    own = enclosing(cwd)
    if own:
        return [Repo(own, os.path.basename(own), "git")]
    here = os.path.abspath(cwd)
    found = discover(here) or [Repo(here, os.path.basename(here), "marker")]
    around = sorted((r for r in found if inside(r.path, here)), key=lambda r: -len(r.path))
    return around + [r for r in found if r not in around]


def chosen(repos: list[Repo], which: str | None, cwd: str = ".") -> list[Repo]:
    """Repositories by name, absolute path, end of the path, or a place inside of one."""
    if not which:
        return repos
    place = os.path.realpath(os.path.join(cwd, which))
    there = os.path.exists(place)
    return [
        r for r in repos
        if r.name == which or os.path.isabs(which) and os.path.realpath(r.path) == place or r.path.endswith("/" + which) or there and inside(os.path.realpath(r.path), place)
    ]


class Workspace:
    """The repositories around a folder with their stores. Syncs run a few at a time, asked-for ones before warm-ups, and at most one
    for each repository; a request that finds one waiting joins it."""

    def __init__(self, spark: SparkSession, cwd: str, stores: str, sync: Callable[[Repo, Store], dict], workers: int = WORKERS) -> None:
        self.spark, self.cwd, self.stores, self.run = spark, cwd, stores.rstrip("/"), sync
        self.repos = repos_of(cwd)
        self.queue: PriorityQueue = PriorityQueue()
        self.order, self.guard = itertools.count(), threading.Lock()
        self.waiting: dict[str, tuple[int, Future]] = {}
        for _ in range(workers):
            threading.Thread(target=self._work, daemon=True).start()

    def store(self, repo: Repo) -> Store:
        return Store(self.spark, f"{self.stores}/{re.sub('[^A-Za-z0-9._-]', '_', repo.path)}", repo.path)

    def select(self, which: str | None = None) -> tuple[list[Repo], int]:
        """At most FANOUT of the chosen repositories, and how many more there are."""
        found = chosen(self.repos, which, self.cwd)
        return found[:FANOUT], max(0, len(found) - FANOUT)

    def sync(self, repo: Repo, asked: bool = True) -> Future:
        """Queue a sync; ``asked`` ones go before warm-ups, also where one is waiting already."""
        with self.guard:
            rank, future = self.waiting.get(repo.path, (2, Future()))
            if rank == 2 or asked and rank:
                self.waiting[repo.path] = (0 if asked else 1, future)
                self.queue.put((0 if asked else 1, next(self.order), repo, future))
            return future

    def _work(self) -> None:
        while True:
            _, _, repo, future = self.queue.get()
            with self.guard:
                if self.waiting.get(repo.path, (0, None))[1] is not future:
                    continue  # it ran as an asked-for one
                del self.waiting[repo.path]
            try:
                future.set_result(self.run(repo, self.store(repo)))
            except Exception as e:  # noqa: BLE001  the caller of result() gets it
                future.set_exception(e)

    def ask(self, question: Callable[[Index], list[str]], which: str | None = None) -> list[str]:
        """Lines of every chosen repository, with its name before each where there are several. One without an index is warmed up."""
        repos, dropped = self.select(which)
        if not repos:
            return [f'No repository matches "{which}".' if which else "No repositories found."]
        out: list[str] = []
        for repo in repos:
            tag = f"[{repo.name}] " if len(repos) > 1 else ""
            store = self.store(repo)
            m = store.manifest()
            if m is None:
                self.sync(repo, asked=False)
                out.append(f"{tag}(index warming up in the background; ask again shortly)")
                continue
            out += [tag + line for line in question(store.load())]
            hint = render.staleness(m.get("synced_at"))
            if hint:
                out.append(tag + hint)
        if dropped:
            out.append(f"(+{dropped} more repositories not searched; name one to ask it)")
        return out
