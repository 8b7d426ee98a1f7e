"""Operators: DataFrame to DataFrame, key columns as parameters."""
