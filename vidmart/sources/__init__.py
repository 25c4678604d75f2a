"""sources of vidmart."""
