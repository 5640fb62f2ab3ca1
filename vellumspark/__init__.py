"""Spark-native audit, repair and census of document packages and text corpora."""
