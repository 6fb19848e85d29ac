"""Memory analytics as Spark DataFrame transformations, for all owners at once."""
