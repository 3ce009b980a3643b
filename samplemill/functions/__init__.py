"""Column functions that the stages are made of."""
