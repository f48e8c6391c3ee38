"""Stateful scan as Structured Streaming."""
