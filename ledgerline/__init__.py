"""Ledgerline: a Spark-native analytics engine for gappy monthly panels."""
