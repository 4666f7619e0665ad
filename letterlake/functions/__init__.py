"""Part of letterlake."""
