"""Adapters from the driver's tables, and whole jobs."""
