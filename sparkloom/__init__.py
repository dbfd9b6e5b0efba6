"""Spark-native catalog, KPI, text-search and training-corpus analytics."""
