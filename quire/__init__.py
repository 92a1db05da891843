"""Spark-native engine that turns raw long-form documents into clean, ordered, deduplicated chapters."""
