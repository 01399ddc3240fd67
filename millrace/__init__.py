"""millrace: plant analytics and corpus preparation as Spark jobs."""
