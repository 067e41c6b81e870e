"""Spark-first analytics over tables, texts, vectors, graphs and event logs."""

__version__ = "0.1.0"
