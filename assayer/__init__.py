"""Assayer: deterministic evidence-and-rules analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
