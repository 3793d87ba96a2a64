"""Geometry codecs and their column functions."""
