"""Readers and writers: acquisition files, plans, exports, Parquet tables."""
