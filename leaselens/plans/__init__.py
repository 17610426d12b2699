"""Queries over the driver's tables and the goldens, with their SQL."""
