"""Spark-native evidence analytics over framed signals, events and text corpora."""
