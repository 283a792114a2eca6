"""Audit analytics for large panels of labelled responses, on Spark."""
