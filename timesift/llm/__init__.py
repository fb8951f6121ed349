"""Corpus operators for training data. Nothing else in this package imports them."""
