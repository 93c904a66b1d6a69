"""Graphs that arrive path by path."""
