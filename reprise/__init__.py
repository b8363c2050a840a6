"""Customer-retention analytics on event data, expressed as Spark DataFrame jobs."""
