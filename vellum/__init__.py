"""Paper-quality analytics and corpus queries as Spark jobs."""
