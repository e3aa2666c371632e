"""Citation-graph and training-data analytics, written as Spark jobs."""
