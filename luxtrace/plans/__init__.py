"""plans of the provenance engine."""
