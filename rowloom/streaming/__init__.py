"""Incremental form of the bulk line conversion."""
