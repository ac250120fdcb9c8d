"""Plans of plantweave."""
