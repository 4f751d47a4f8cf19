"""Sources of the vector engine."""
