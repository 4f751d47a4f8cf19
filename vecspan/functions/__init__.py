"""Column functions over ARRAY<DOUBLE> vectors and scalar schedules."""
