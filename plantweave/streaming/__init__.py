"""Streaming of plantweave."""
