"""PySpark-native analytics over large text and code corpora."""
