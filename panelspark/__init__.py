"""panelspark: panel and factor analytics written as Spark jobs."""
