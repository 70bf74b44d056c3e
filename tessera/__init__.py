"""Tessera: a Spark-first engine for documentation retrieval and corpus processing."""
