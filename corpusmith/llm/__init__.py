"""Operators that prepare text and code for the training of language models."""
