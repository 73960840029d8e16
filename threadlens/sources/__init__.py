"""Readers: thread files, annotation lists, title lists, the typed table."""
