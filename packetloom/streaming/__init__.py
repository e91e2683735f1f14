"""Structured Streaming forms of the windows and sessions."""
