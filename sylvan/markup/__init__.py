"""Parsing and writing HTML: one document at a time, without Spark."""
