"""Operators for large text corpora: mixing, language id, tokenizers, quality, language-model
scoring, toxicity, near and exact duplicates, URL filters.

Nothing outside this package imports it. Each operator module keeps its own interface;
``queries`` holds the thin registered queries.
"""
