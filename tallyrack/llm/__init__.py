"""Operators for training data: language, near copies, leaks, secrets, mixing, chat, tokens, quality, pages, vectors.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames.
"""
