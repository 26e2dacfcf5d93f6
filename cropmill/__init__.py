"""cropmill: a Spark-native engine for curating annotation-level embedding tables."""

__version__ = "0.1.0"
