"""Linkage of record streams."""
