"""X-09: factories by name. A model or pipeline registers under a kind and a name, and is made again from a plain configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from tidemark.sources.shared import read_text

_FACTORIES: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str | None = None):
    """A decorator for classes and functions; the name defaults to theirs."""

    def put(f):
        _FACTORIES[kind, name or f.__name__] = f
        return f

    return put


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _FACTORIES if k == kind)


def make(kind: str, config: Mapping):
    """From {"name": ..., "params": {...}}; an unknown name is an error that lists the known ones."""
    f = _FACTORIES.get((kind, config["name"]))
    if f is None:
        raise KeyError(f"no {kind} is called {config['name']}; there are {', '.join(names(kind)) or 'none'}")
    return f(**config.get("params", {}))


def load(kind: str, path: str):
    return make(kind, json.loads(read_text(path)))
