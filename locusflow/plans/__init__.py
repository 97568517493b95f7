"""Queries over the driver's tables, each with SQL of its own kind to hold it against."""
