"""Spark-native operators for detection, tracking and annotation tables."""
