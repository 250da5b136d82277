"""Text and time expressions of log and metric frames."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import micros


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_replacement(text: str) -> str:
    """${1} groups as Java writes them."""
    return re.sub(r"\$\{(\d+)\}", r"$\1", text)


def replaced(df: DataFrame, *, column: str, pattern, replacement, out_column: str | None = None) -> DataFrame:
    """C-01: all matches replaced; pattern and replacement are texts or columns."""
    new = replacement if isinstance(replacement, Column) else F.lit(java_replacement(replacement))
    return df.withColumn(out_column or f"{column}_mapped", F.regexp_replace(F.col(column), pattern if isinstance(pattern, Column) else F.lit(pattern), new))


def first_characters(c: str | Column, n: int) -> Column:
    """C-02."""
    return F.substring(_col(c), 1, n)


def stripped(c: str | Column) -> Column:
    """C-03: without white space of any kind at both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def extracted(c: str | Column, pattern: str, group: int = 1) -> Column:
    """C-04: a group of the first match, null without one."""
    return F.when(F.regexp_like(_col(c), F.lit(pattern)), F.regexp_extract(_col(c), pattern, group))


def extracted_all(c: str | Column, pattern: str, group: int = 0) -> Column:
    """C-04: of all matches."""
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


def parsed_datetime(df: DataFrame, column: str, fmt: str | None = None, time_zone: str | None = None) -> DataFrame:
    """F-08, C-05: strings parsed strictly (a bad one makes the query fail), dates and timestamps cast; with a zone, local times become
    UTC."""
    kind = df.schema[column].dataType.typeName()
    if kind not in ("string", "date", "timestamp", "timestamp_ntz"):
        raise TypeError(f"{column} is {kind}, not a time")
    c = F.col(column)
    t = F.to_timestamp_ntz(c, F.lit(fmt)) if kind == "string" and fmt else c.cast("timestamp_ntz")
    if time_zone:
        t = F.to_utc_timestamp(t.cast("timestamp"), time_zone).cast("timestamp_ntz")
    return df.withColumn(column, t)


def from_epoch(c: str | Column) -> Column:
    """C-06."""
    return F.timestamp_seconds(_col(c))


def is_labelled(c: str | Column, none: str = "-") -> Column:
    """C-07."""
    return _col(c) != F.lit(none)


def tokens(c: str | Column) -> Column:
    """C-08."""
    return F.split(stripped(c), r"\s+")


def iso_millis(c: str | Column) -> Column:
    """C-16: ISO with truncated milliseconds and Z."""
    return F.date_format(F.date_trunc("millisecond", _col(c).cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def shifted(c: str | Column, seconds: int) -> Column:
    """C-17."""
    return _col(c) + F.expr(f"INTERVAL '{seconds}' SECOND")


#: Seconds of the usual cycles.
PERIODS = {"hour": 3600, "day": 86_400, "week": 604_800}


def cyclic_features(df: DataFrame, time_column: str, periods: Mapping[str, float] | None = None, *, prefix: str | None = None, compat_microseconds: bool = False) -> DataFrame:
    """C-11, C-12, Q-11: cosine and sine of a time's place in each period, as <prefix>_<name>_cos and _sin (without prefix, <name>_sin and
    _cos). compat_microseconds takes the epoch in microseconds with periods in seconds."""
    t = micros(time_column)
    out = {}
    for name, seconds in (PERIODS if periods is None else periods).items():
        span = int(seconds if compat_microseconds else seconds * 1_000_000)
        angle = F.pmod(t, F.lit(span)) * (2 * 3.141592653589793 / span)
        stem = f"{prefix}_{name}" if prefix else name
        out |= {f"{stem}_cos": F.cos(angle), f"{stem}_sin": F.sin(angle)} if prefix else {f"{stem}_sin": F.sin(angle), f"{stem}_cos": F.cos(angle)}
    return df.withColumns(out) if out else df


def grouped_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Q-08: (pattern, mask name) rules by mask name, names in the order in which they first come."""
    names = dict.fromkeys(name for _, name in rules)
    return [(p, n) for n in names for p, m in rules if m == n]


def masked(c: str | Column, rules: Sequence[tuple[str, str]]) -> Column:
    """L-03: all matches of each rule's pattern become its mask name, rule by rule."""
    out = _col(c)
    for pattern, name in grouped_rules(rules):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(java_replacement(name)))
    return out


def prepared(c: str | Column, rules: Sequence[tuple[str, str]] = (), slice_length: int | None = None, strip: bool = True) -> Column:
    """L-02, L-09: cut, then stripped, then masked."""
    out = _col(c)
    if slice_length is not None:
        out = first_characters(out, slice_length)
    if strip:
        out = stripped(out)
    return masked(out, rules)
