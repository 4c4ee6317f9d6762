"""Collections, stores and text forms."""
