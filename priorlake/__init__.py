"""Leakage-safe forecasting analytics as PySpark DataFrame operators."""
