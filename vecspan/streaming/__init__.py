"""Streaming of the vector engine."""
