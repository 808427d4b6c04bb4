"""Dataflow operators: DataFrames in, DataFrames out, nothing is run."""
