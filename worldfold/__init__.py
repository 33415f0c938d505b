"""Bitemporal world-state analytics, and corpus operators, as Spark DataFrame programs."""

__version__ = "0.1.0"
