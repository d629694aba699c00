"""Operators of spectraloom."""
