"""Incremental collection of thread files."""
