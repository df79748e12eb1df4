"""Difference analytics on Apache Spark."""
