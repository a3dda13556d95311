"""Spark-first engine for agent-session memory data (see README.md)."""

__version__ = "0.1.0"
