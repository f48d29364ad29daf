"""Foliant: document intelligence as Spark DataFrame jobs."""
