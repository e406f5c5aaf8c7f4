"""runweave: a PySpark-native analytics engine for batch-workload estates."""

__version__ = "0.1.0"
