"""Column functions and small renderers."""
