"""Tidemark: analytics over libraries of observed records, as Spark jobs."""
