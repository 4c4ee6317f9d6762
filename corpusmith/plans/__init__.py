"""The index and the registered queries."""
