"""Queries over the driver's tables, each with its SQL twin."""
