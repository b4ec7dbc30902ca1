"""Extraction and sinks."""
