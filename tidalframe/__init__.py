"""Spark-native analytics for reef observation tables, image sets and scoring requests."""

__version__ = "0.1.0"
