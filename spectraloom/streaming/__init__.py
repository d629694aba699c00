"""Streaming of spectraloom."""
