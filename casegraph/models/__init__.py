"""Calls of language and vision models, and the documents that are read with them."""
