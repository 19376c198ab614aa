"""Streaming of pointweave."""
