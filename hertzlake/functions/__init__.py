"""Functions of the frequency engine."""
