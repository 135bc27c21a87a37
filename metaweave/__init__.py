"""Typed-graph community analytics on Spark."""
