"""Operators for training-text pipelines; each stands alone and nothing else in the library imports them."""
