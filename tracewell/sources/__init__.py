"""Readers of articles."""
