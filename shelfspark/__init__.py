"""Catalog readiness and shopper-retrieval jobs on Spark."""
