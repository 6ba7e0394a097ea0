"""Operators over repository tables."""
