"""Dependency-graph and schema-model analytics as plain Spark DataFrame jobs."""

__version__ = "0.1.0"
