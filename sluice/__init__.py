"""sluice: leak-prevention analytics and text pipelines as Spark jobs."""
