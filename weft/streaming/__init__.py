"""Accumulation over pages, as batches and as streams."""
