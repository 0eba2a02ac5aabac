"""ledgerloom: a Spark-first engine for report knowledge bases and their text data."""

__version__ = "0.1.0"
