"""tidemark: log and metric anomaly analytics expressed as Spark DataFrame operations."""

__version__ = "0.1.0"
