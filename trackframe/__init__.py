"""trackframe: motion-data analytics as Spark DataFrame jobs."""
