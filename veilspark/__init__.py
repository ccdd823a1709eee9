"""Privacy-exposure analytics as Spark jobs."""
