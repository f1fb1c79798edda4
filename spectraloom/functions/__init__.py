"""Column helpers, order statistics and distribution functions."""
