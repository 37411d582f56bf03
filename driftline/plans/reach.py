"""What a query is made from, and which queries a change can reach."""

from __future__ import annotations

import types
from collections import deque
from collections.abc import Callable, Iterable

PACKAGE = __name__.split(".")[0]


def _names(code: types.CodeType) -> set[str]:
    """All names that a function's code refers to, its inner functions' included."""
    out = set(code.co_names)
    for c in code.co_consts:
        if isinstance(c, types.CodeType):
            out |= _names(c)
    return out


def uses(f: Callable) -> set[Callable]:
    """This package's functions that a function refers to, by name or through a module that it names."""
    names = _names(f.__code__)
    mine = lambda o: isinstance(o, types.FunctionType) and o.__module__.split(".")[0] == PACKAGE
    found = set()
    for n in names:
        o = f.__globals__.get(n)
        if mine(o):
            found.add(o)
        elif isinstance(o, types.ModuleType) and o.__name__.split(".")[0] == PACKAGE:
            found |= {g for m in names if mine(g := getattr(o, m, None))}
    return found - {f}


def label(f: Callable) -> str:
    return f"{f.__module__.removeprefix(PACKAGE + '.')}.{f.__name__}"


def inputs(queries: dict[str, Callable], sql: dict[str, str] | None = None, tables: Iterable[str] = ()) -> dict[str, set[str]]:
    """What each query, and each function below one, refers to directly: functions by label; and the tables that a query's SQL names."""
    out: dict[str, set[str]] = {}
    todo = deque((q, f) for q, f in queries.items())
    while todo:
        name, f = todo.popleft()
        if name in out:
            continue
        below = uses(f)
        out[name] = {label(g) for g in below}
        todo.extend((label(g), g) for g in below)
    for q, text in (sql or {}).items():
        if q in out:
            words = set(text.replace("(", " ").replace(")", " ").replace(",", " ").split())
            out[q] |= {t for t in tables if t in words}
    return out


def affected(graph: dict[str, set[str]], changed: Iterable[str]) -> dict[str, list[str]]:
    """Everything that a change of functions, modules or tables reaches, each with the way from the change to it; nothing else can have moved.

    A module's name stands for all its functions.
    """
    users: dict[str, set[str]] = {}
    for name, below in graph.items():
        for b in below:
            users.setdefault(b, set()).add(name)
    known = set(graph) | set(users)
    seeds = {k for c in changed for k in known if k == c or k.startswith(f"{c}.")}
    if missing := sorted(c for c in changed if not any(k == c or k.startswith(f"{c}.") for k in known)):
        raise KeyError(f"nothing is called {missing}")
    way = {s: [s] for s in sorted(seeds)}
    todo = deque(sorted(seeds))
    while todo:
        at = todo.popleft()
        for u in sorted(users.get(at, ())):
            if u not in way:
                way[u] = [*way[at], u]
                todo.append(u)
    return way
