"""operators of the provenance engine."""
