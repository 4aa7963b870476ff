"""Operators for building training data: tokens, quality, duplicates, extraction, packing and chat text."""
