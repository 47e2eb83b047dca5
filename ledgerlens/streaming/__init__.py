"""Structured Streaming jobs over append-only event sources."""
