"""Ball-by-ball cricket analytics as Spark jobs."""
