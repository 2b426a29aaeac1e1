"""Batch operators: plain ``DataFrame -> DataFrame`` functions."""
