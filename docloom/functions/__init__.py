"""Column expressions: text, type detection, rendering. All native."""
