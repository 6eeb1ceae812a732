"""Frequency estimation on electrical waveforms as Spark plans."""
