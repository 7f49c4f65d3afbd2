"""Spark-native analytics over tiled-image tables."""
