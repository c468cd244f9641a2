"""The transcript operators on streams."""
