"""Health-aware recommendation analytics as PySpark DataFrame jobs."""
