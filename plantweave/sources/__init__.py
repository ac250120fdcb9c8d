"""Sources of plantweave."""
