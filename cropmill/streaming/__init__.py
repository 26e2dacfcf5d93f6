"""Structured Streaming forms of the frame and log readers."""
