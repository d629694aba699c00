"""Sources of spectraloom."""
