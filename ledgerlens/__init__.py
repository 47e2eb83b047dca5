"""ledgerlens: governed, explainable data work on tables, text and event logs, written as Spark jobs."""

__version__ = "0.1.0"
