"""Training-data preparation and feed analytics as Spark jobs."""
