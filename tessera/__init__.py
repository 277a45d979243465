"""Spark-native analytics over dated, attributed text and the entities around it."""
