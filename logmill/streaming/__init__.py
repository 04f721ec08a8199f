"""Structured Streaming: raw log streams and parsing with a dictionary that persists."""
