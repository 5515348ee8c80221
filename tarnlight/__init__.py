"""Tarnlight: narrative analytics and training-data preparation on PySpark."""
