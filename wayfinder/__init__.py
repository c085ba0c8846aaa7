"""A typed knowledge graph over source repositories (or tables put on the same model), with hybrid search, as Spark jobs."""
