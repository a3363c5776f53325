"""Spark-native engine for finding, masking and restoring sensitive data in text."""
