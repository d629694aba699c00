"""Plans of spectraloom."""
