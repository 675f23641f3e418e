"""Conversational-memory analytics as Spark DataFrame transforms."""
