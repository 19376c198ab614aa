"""Operators of pointweave."""
