"""Image-provenance analytics and corpus preparation as PySpark plans."""
