"""Log-audit analytics as Spark jobs."""
