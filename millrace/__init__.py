"""Spark-first retrieval, evaluation and corpus operators."""
