"""Structured Streaming operators (an extension)."""
