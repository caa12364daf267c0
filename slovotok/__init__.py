"""slovotok: a PySpark-native engine for rule-based proofreading and text data processing at corpus scale."""
