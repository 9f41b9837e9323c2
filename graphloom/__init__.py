"""Graph and knowledge analytics as plain Spark DataFrame operators."""
