"""Selectors: their grammar, a matcher for one tree, and plans over node tables."""
