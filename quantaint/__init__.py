"""Tuple inconsistency measures and answer-quality scores as Spark jobs."""
