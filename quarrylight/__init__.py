"""quarrylight: a PySpark-native engine for auditing and mining crawled web material."""

__version__ = "0.1.0"
