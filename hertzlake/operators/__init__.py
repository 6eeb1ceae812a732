"""Operators of the frequency engine."""
