"""Functions of plantweave."""
