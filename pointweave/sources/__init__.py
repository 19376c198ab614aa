"""Sources of pointweave."""
