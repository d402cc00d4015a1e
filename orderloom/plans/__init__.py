"""Whole flows from landing tables to results."""
