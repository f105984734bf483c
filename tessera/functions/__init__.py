"""Scalar functions as column expressions, and readers of titles."""
