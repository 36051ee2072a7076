"""knowloom: a Spark-native engine for document-driven knowledge bases."""

__version__ = "0.1.0"
