"""Multi-step compositions and the query catalogue."""
