"""Reproducible studies on large tables with Spark."""
