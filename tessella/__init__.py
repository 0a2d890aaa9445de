"""Tessella: a DataFrame-first analytics engine on PySpark."""

__version__ = "0.1.0"
