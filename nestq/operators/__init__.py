"""Operators with a compiler of their own."""
