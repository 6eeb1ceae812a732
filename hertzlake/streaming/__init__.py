"""Streaming of the frequency engine."""
