"""Structured Streaming forms of the daily roll-up, de-duplication and exposure."""
