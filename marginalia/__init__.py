"""Spark-first analytics over linked notes, their sync state and training text."""
