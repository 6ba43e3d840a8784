"""Spark-native processing of multi-view feature data: match graphs, descriptor patches, references, adjustment, localisation and their quality checks."""

__version__ = "0.1.0"
