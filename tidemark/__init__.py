"""Tidemark: time-aware document analytics as PySpark DataFrame plans."""
