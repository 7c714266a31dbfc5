"""Operators over unbounded clouds, by Structured Streaming."""
