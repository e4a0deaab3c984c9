"""DataFrame operators of the extraction-scoring engine."""
