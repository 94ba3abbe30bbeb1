"""Column expressions used by the normalisation and matching jobs."""
