"""Spark-native document analytics: text, retrieval, topics, tables, streams and corpus curation."""
