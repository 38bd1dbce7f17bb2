"""Readers, source-specific projections and sinks."""
