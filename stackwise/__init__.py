"""PySpark-native analytics for messy resource catalogs."""

__version__ = "0.1.0"
