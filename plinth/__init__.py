"""plinth: a PySpark-native join, aggregation and analysis engine."""
