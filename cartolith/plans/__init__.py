"""Conversion plans: what the command line verbs do."""
