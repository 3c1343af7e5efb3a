"""Query text and records by meaning, as Spark plans."""

__version__ = "0.1.0"
