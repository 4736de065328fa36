"""Customer-growth analytics as Spark DataFrame jobs."""
