"""Spark-first analytics for recordings of people working together."""
