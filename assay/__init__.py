"""assay: measure, repair and certify business tables with plain Spark jobs."""
