"""X-10, C-21: loggers, timing, seeds and names of runs."""

from __future__ import annotations

import logging
import random
import time
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime

import numpy as np


def logger(name: str, level: int | str = logging.INFO) -> logging.Logger:
    """A logger with one handler, however often it is asked for."""
    out = logging.getLogger(name)
    out.setLevel(level)
    if not out.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        out.addHandler(handler)
    return out


@contextmanager
def timed(what: str, log: logging.Logger | None = None):
    """Logs the seconds that a block takes; yields a dictionary that has them afterwards."""
    out: dict[str, float] = {}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        (log or logger("tidemark")).info("%s took %.3f s", what, out["seconds"])


def seeded(seed: int) -> np.random.Generator:
    """Seeds Python's and NumPy's global generators, and returns one of its own. Spark's functions take seeds as arguments."""
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)


def run_name(prefix: str = "run", now: datetime | None = None, mark: str | None = None) -> str:
    """prefix_YYYYMMDD_HHMMSS_mark; the mark is eight random hexadecimal digits, unless it is given."""
    return f"{prefix}_{(now or datetime.now(UTC)):%Y%m%d_%H%M%S}_{mark or uuid.uuid4().hex[:8]}"
