"""Scalar functions and text forms of rules."""
