"""Operators over occurrences, names, files and measures."""
