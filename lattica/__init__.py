"""Spark-native mesh database: entities, sets and tags as DataFrames."""
