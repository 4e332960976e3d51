"""Structured Streaming operators with carried state."""
