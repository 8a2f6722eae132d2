"""Operators over node tables and selections."""
