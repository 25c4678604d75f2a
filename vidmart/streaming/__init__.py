"""streaming of vidmart."""
