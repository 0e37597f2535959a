"""Part of papersluice."""
