"""Profiling and normalising of text columns on Spark."""
