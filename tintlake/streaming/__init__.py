"""Structured Streaming jobs over arriving pixel files."""
