"""Pipelines: stages folded over a DataFrame, epochs and batches."""
