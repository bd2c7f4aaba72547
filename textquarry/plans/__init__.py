"""Composed plans: the retrieval engine, its response contract and the answer flow."""
