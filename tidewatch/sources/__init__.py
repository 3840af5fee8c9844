"""Readers, data contracts and sinks."""
