"""Queries: operators put together and registered by name."""
