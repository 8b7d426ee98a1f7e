"""Column functions. Those that Spark's built-ins can say are plain column expressions; the others are Arrow UDFs."""
