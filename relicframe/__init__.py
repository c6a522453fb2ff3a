"""Spark-native analytics over archives of tagged binary records, and training-data operators."""
