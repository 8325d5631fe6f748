"""Structured Streaming jobs and the files their state lives in."""
