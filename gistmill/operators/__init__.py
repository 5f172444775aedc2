"""Operators over document sets."""
