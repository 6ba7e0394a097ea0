"""Parsers: recursive descent for statements, precedence climbing for expressions."""
