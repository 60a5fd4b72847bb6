"""cairn: point-cloud and multi-view geometry analytics on PySpark DataFrames."""

__version__ = "0.1.0"
