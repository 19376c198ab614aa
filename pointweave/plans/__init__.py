"""Plans of pointweave."""
