"""Readers and writers: JSON, CSV, five Parquet tables, logs, site configurations, file listings."""
