"""Functions of pointweave."""
