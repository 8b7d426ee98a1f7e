"""Streaming forms of the incremental operators. The batch forms are in `operators`."""
