"""Embedding geometry and historical series on Spark."""
