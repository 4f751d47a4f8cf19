"""Plans of the vector engine."""
