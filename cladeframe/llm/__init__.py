"""Operators for preparing text corpora: language, tokens, copies, neighbours, toxicity, pages, packing and URLs."""
