"""lexiloom: a PySpark-native engine for literature set retrieval and record-level data quality."""
