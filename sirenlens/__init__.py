"""Alert-stream quality analytics as Spark DataFrame jobs."""
