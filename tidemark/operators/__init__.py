"""Operators over changelogs, runs and file metadata."""
