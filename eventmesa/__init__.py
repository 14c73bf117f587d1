"""Event-study analytics expressed as Spark DataFrame jobs."""
