"""A PySpark-native analytics engine for one-minute market bars and raw feed data."""

__version__ = "0.1.0"
