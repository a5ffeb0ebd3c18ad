"""A Spark-native evidence-analytics engine."""
