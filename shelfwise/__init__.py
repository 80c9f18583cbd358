"""Media-library analytics and corpus preparation as plain Spark jobs."""
