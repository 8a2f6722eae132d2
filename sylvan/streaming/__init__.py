"""The same transforms on streams of pages."""
