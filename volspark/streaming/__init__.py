"""Structured Streaming jobs over tick streams."""
