"""Paraforge: contract-checked Parquet data movement on PySpark."""
