"""Code-quality and refactoring analytics expressed as Spark jobs."""
