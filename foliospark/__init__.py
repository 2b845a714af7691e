"""foliospark: Spark jobs for document libraries and training-data pipelines."""
