"""PySpark-native analytics over ordered, categorical and spatial event data."""

__version__ = "0.1.0"
