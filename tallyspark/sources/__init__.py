"""Readers (files to DataFrames, explicit schemas, no inference) and deterministic writers."""
