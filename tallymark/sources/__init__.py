"""Readers of files that are not tables."""
