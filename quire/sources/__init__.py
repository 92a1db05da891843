"""Readers: parquet tables, TXT and EPUB files, link lists, configuration."""
