"""Spark-native registration and analytics over ordered frame streams."""
