"""Spark-native analytics over relations, graphs, change sets and text facts."""
