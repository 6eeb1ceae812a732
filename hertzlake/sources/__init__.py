"""Sources of the frequency engine."""
