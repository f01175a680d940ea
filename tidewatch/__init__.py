"""Model and data monitoring expressed as Spark DataFrame and Structured Streaming jobs."""
