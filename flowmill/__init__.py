"""Spark-native preparation, auditing and evaluation of labelled flow records."""

__version__ = "0.1.0"
