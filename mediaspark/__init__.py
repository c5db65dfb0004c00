"""Media retrieval, timeline and de-duplication analytics as Spark jobs."""
