"""Structured Streaming jobs; each returns a streaming frame or a configured writer."""
