"""Operators for preparing training corpora; see README for the list."""
