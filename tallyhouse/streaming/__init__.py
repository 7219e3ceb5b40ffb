"""Continuous ingestion of a drop folder."""
