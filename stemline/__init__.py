"""Spark-native analytics for labelled 3-D point data."""
