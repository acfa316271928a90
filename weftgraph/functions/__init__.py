"""Scalar, vector and aggregate functions."""
