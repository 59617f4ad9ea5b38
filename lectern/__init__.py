"""Lectern: a PySpark-native engine for document catalogs, retrieval and training data."""
