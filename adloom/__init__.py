"""Spark-native click-through-rate analytics: operators are functions from DataFrames to DataFrames."""
