"""Sensitive-content analytics on Spark: rule catalogues compiled to DataFrame plans."""
