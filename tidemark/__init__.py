"""Spark-native analytics over multi-seller listings: DataFrame in, DataFrame out."""
