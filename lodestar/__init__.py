"""Lodestar: a PySpark-native engine for fusing events, reference data and time series."""
