"""functions of vidmart."""
