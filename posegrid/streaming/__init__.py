"""Structured Streaming forms of the frame operators."""
