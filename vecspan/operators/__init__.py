"""Operators of the vector engine."""
