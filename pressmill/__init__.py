"""Article-corpus analytics as Spark DataFrame jobs."""
