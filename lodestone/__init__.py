"""Spark-native analytics over source code, pull-request text and document corpora."""
