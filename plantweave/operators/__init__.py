"""Operators of plantweave."""
