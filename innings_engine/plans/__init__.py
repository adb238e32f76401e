"""Multi-operator jobs and the query catalogue."""
