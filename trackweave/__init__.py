"""A Spark-native engine for similarity graphs over track libraries."""
