"""Spark-native analytics over ordered observation tables."""
