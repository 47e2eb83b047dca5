"""Readers, schema inspection and sinks."""
