"""cadenza: a PySpark-native engine for pronunciation-learning data."""
