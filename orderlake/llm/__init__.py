"""Operators that prepare text and vectors for training language models."""
