"""Spark-native analytics for collections of long documents."""

__version__ = "0.1.0"
