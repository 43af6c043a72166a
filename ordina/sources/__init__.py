"""Readers and writers of CSV, XLSX, Feather and Parquet files, and tables from memory."""
