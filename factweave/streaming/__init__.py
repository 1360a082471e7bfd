"""Continuous intake of facts by Structured Streaming."""
