"""Readers of files to be loaded into tables."""

from tidelake.sources.files import find, load_csv, load_parquet, load_text, read_csv, read_parquet, read_text, to_timestamp_by_magnitude, unescape

__all__ = ["find", "load_csv", "load_parquet", "load_text", "read_csv", "read_parquet", "read_text", "to_timestamp_by_magnitude", "unescape"]
