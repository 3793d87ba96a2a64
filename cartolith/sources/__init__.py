"""Readers and writers of layer formats."""
