"""Queries over the driver's tables, grouped as the survey groups its operators."""
