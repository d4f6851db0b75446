"""Column builders made only of built-in Spark expressions."""
