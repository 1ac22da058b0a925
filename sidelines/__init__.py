"""Sports tracking analytics as Spark DataFrame jobs."""
