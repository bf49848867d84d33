"""Spark-native scan of source-code corpora for unsafe logging and exception handling."""

from siftspark.options import ScanOptions

__all__ = ["ScanOptions"]
