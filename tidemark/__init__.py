"""Point-in-time event studies and factor research as Spark DataFrame pipelines."""
