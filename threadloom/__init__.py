"""Snapshot-aware analytics over conversation archives, expressed as Spark DataFrames."""
