"""Readers, sinks and the materialisation helper."""
