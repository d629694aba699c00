"""Functions of spectraloom."""
