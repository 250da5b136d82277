"""M-09, S-16: a metric model and all that scoring needs, in one folder of any file system that Spark reaches."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.operators.scaling import Scaler
from tidemark.operators.scoring import LSTMAutoEncoder, MetricLSTM
from tidemark.operators.windows import WHOLE
from tidemark.plans.metrics import inferred
from tidemark.registry import make, register
from tidemark.sources.shared import read_text, write_text

register("weights", "lstm")(LSTMAutoEncoder.load)
register("weights", "metric_lstm")(MetricLSTM.load)


@dataclass
class MetricPipeline:
    """model: a name among the registered kinds of weights, or any that register("weights", name) adds."""

    model: LSTMAutoEncoder
    scaler: Scaler
    columns: Sequence[str]
    threshold: float
    window_size: int = 10
    periods: Mapping[str, float] = field(default_factory=dict)

    def infer(self, df: DataFrame, *, timestamp_col: str, partition_by=WHOLE, top_k: int = 10) -> tuple[DataFrame, DataFrame]:
        """M-08."""
        return inferred(df, timestamp_col=timestamp_col, metric_columns=self.columns, scaler=self.scaler, model=self.model, threshold=self.threshold, window_size=self.window_size, periods=self.periods, partition_by=partition_by, top_k=top_k)

    def save(self, folder: str) -> None:
        at = folder.rstrip("/")
        kind = "metric_lstm" if isinstance(self.model, MetricLSTM) else "lstm"
        write_text(json.dumps({"model": kind, "window_size": self.window_size, "periods": dict(self.periods)}), f"{at}/model_config.json")
        write_text(json.dumps({"threshold": self.threshold}), f"{at}/anomaly_threshold.json")
        write_text(json.dumps(list(self.columns)), f"{at}/columns.json")
        write_text(self.scaler.to_json(), f"{at}/scalers.json")
        self.model.save(f"{at}/model.npz")

    @classmethod
    def from_folder(cls, folder: str, **other) -> MetricPipeline:
        """other: fields in place of the folder's, such as another window_size. Times among the columns are no metrics."""
        at = folder.rstrip("/")
        config = json.loads(read_text(f"{at}/model_config.json"))
        fields = {
            "model": make("weights", {"name": config["model"], "params": {"path": f"{at}/model.npz"}}),
            "scaler": Scaler.from_json(read_text(f"{at}/scalers.json")),
            "columns": [c for c in json.loads(read_text(f"{at}/columns.json")) if c not in ("timestamp", "index")],
            "threshold": json.loads(read_text(f"{at}/anomaly_threshold.json"))["threshold"],
            "window_size": config.get("window_size", 10),
            "periods": config.get("periods", {}),
        }
        return cls(**{**fields, **other})
