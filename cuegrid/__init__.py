"""A Spark-native engine for timed text."""
