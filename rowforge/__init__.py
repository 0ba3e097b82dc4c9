"""Tabular scoring, document queries and request analytics as Spark jobs."""
