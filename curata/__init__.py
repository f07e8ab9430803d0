"""Spark-native dataset curation and classifier evaluation."""
