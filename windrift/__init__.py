"""windrift: Spark-native KPI feature preparation and data-drift scoring."""

__version__ = "0.1.0"
