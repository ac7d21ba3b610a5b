"""Spark-native search and data processing over source code and its documentation."""
