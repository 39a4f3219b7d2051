"""Composite plans: yearly load, measure catalogue, fact sheet, full report."""
