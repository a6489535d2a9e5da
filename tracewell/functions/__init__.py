"""Subpackage of the evidence-linking engine."""
