"""Scans and sinks: parquet tables, the fault-tolerant CSV scan, charsets."""
