"""Article-archive analytics as Spark jobs."""
