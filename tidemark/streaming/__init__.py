"""Continuous ingest and the latest view of a stream."""
