"""Lakehouse, vector and event-stream operators written for PySpark."""
