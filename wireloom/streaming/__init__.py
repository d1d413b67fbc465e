"""Graphs that arrive as a stream."""
