"""Race-listing integration and search as Spark DataFrame operators."""
