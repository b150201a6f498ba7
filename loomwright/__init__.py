"""Corpus building, guarded retrieval and evaluation as Spark DataFrame jobs."""
