"""Operators for training data: they use the rest of the library, and nothing of the rest uses them."""
