"""Scalers of metric columns: parameters come from one exact aggregate over all columns, and apply as plain expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import quantiles

EPSILON = 1e-6
KINDS = ("StandardScaler", "RobustScaler", "custom", "MinMaxScaler")


@dataclass
class Scaler:
    """N-02 .. N-07: centre and scale of each column; custom takes the inverse hyperbolic sine first and sets constant columns to 0.

    quantile_range: of RobustScaler and custom, in percent (N-03: 5 to 95).
    """

    kind: str = "StandardScaler"
    quantile_range: tuple[float, float] = (5.0, 95.0)
    iqr_epsilon: float = EPSILON
    params: dict[str, dict] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown normalisation: {self.kind}")

    def _value(self, c: str) -> Column:
        x = F.col(c).cast("double")
        return F.asinh(x) if self.kind == "custom" else x

    def fit(self, df: DataFrame, columns: Sequence[str]) -> Scaler:
        """All columns at once; columns that are not there are left out."""
        columns = [c for c in columns if c in df.columns]
        lo, hi = (q / 100 for q in self.quantile_range)
        aggs = []
        for c in columns:
            x = self._value(c)
            if self.kind == "StandardScaler":
                aggs += [F.avg(x).alias(f"{c}|a"), F.stddev_pop(x).alias(f"{c}|b")]
            elif self.kind == "MinMaxScaler":
                aggs += [F.min(x).alias(f"{c}|a"), F.max(x).alias(f"{c}|b")]
        row = df.agg(*aggs).first().asDict() if aggs else {}
        at = quantiles(df, {c: self._value(c) for c in columns}, [0.5, lo, hi, 0.25, 0.75]) if self.kind in ("RobustScaler", "custom") else {}
        for c in columns:
            if self.kind == "StandardScaler":
                centre, scale, constant = row[f"{c}|a"], row[f"{c}|b"], False
            elif self.kind == "MinMaxScaler":
                a, b = row[f"{c}|a"], row[f"{c}|b"]
                centre, scale, constant = a, None if a is None else b - a, False
            else:
                q = at[c] or [None] * 5
                centre, scale = q[0], None if q[0] is None else q[2] - q[1]
                constant = self.kind == "custom" and (q[0] is None or q[4] - q[3] < self.iqr_epsilon)
            self.params[c] = {"centre": centre if centre is not None else 0.0, "scale": scale or 1.0, "constant": constant}
        return self

    def transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """N-06: unfitted scalers fail; columns without parameters or not in the frame are left as they are."""
        if not self.params:
            raise ValueError("the scaler has not been fitted")
        out = {}
        for c in columns if columns is not None else self.params:
            p = self.params.get(c)
            if p and c in df.columns:
                out[c] = F.lit(0.0) if p["constant"] else (self._value(c) - p["centre"]) / p["scale"]
        return df.withColumns(out) if out else df

    def fit_transform(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """N-05."""
        return self.fit(df, columns).transform(df)

    def to_json(self) -> str:
        """N-07, Q-19: with the real kind of scaler."""
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Scaler:
        """N-07: a bare mapping of parameters is taken as a RobustScaler's."""
        d = json.loads(text)
        if "kind" not in d:
            return cls("RobustScaler", params=d)
        return cls(d["kind"], tuple(d["quantile_range"]), d["iqr_epsilon"], d["params"])


_BASES = {"minmax": "MinMaxScaler", "standard": "StandardScaler", "robust": "RobustScaler"}


def scale(df: DataFrame, columns: Sequence[str], *, base_transform: str = "minmax", per_column: Mapping[str, str] | None = None, fitted: Mapping[str, Scaler] | None = None, remainder: str = "passthrough") -> tuple[DataFrame, dict[str, Scaler]]:
    """N-01, A-12: columns scaled in groups by kind, and the scalers; scaled columns come first, then the others (remainder drop: none).
    Fitted scalers are only applied."""
    per = {c: (per_column or {}).get(c, base_transform) for c in columns}
    if unknown := set(per.values()) - set(_BASES):
        raise ValueError(f"unknown transform: {sorted(unknown)}")
    groups: dict[str, list[str]] = {}
    for c, kind in per.items():
        groups.setdefault(kind, []).append(c)
    scalers = dict(fitted or {})
    out = df
    for kind, cs in groups.items():
        if kind not in scalers:
            scalers[kind] = Scaler(_BASES[kind], (25.0, 75.0)).fit(df, cs)
        out = scalers[kind].transform(out, cs)
    first = [c for cs in groups.values() for c in cs]
    return out.select(*first, *(c for c in df.columns if c not in per and remainder == "passthrough")), scalers
