"""Bulk resolution of legal references, and the operations around it, on Spark."""
