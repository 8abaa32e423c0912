"""millrace: a PySpark-native dataflow analytics engine."""
