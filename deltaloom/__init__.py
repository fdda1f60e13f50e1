"""A PySpark-native engine for change analysis and training-data pipelines."""
