"""Scalar and row-wise column functions."""
