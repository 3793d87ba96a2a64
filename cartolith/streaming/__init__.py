"""Layers as streams."""
