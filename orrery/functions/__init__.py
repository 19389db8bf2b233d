"""Scalar and aggregate functions with the dialect's value semantics."""
