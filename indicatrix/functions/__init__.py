"""Column-level building blocks: normalisation, matching, validation."""
