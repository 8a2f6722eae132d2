"""Readers that turn pages into node tables."""
