"""Corpus and repository analytics as Spark DataFrame jobs."""
