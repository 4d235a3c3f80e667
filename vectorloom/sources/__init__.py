"""Readers, formats and stored state."""
