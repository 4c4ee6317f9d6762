"""Column functions and helpers that every part uses."""
