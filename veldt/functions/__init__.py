"""Scalar functions as column expressions, and structural validators."""
