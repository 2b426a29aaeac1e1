"""Readers, sinks and the shared scratch location."""
