"""operators of vidmart."""
