"""Scans and sinks: driver parquet tables, typed CSV, stage tables."""
