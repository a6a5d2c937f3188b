"""Sequence screening, model evaluation and corpus preparation as Spark DataFrame jobs."""
