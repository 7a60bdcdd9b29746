"""The same on streams."""
