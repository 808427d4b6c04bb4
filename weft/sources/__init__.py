"""Readers of the artefacts and writers of results; everything goes through Spark's own readers and writers."""
