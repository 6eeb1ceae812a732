"""Plans of the frequency engine."""
