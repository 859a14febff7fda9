"""Queries over the driver's tables, and composites that answer whole requests."""
