"""Column functions (native Spark expressions, no UDFs)."""
