"""Spark-native scoring of predicted library structures, and training-data operators."""
