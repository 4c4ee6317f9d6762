"""Retrieval operators: lists, search, snippets, codecs, vectors and reordering."""
