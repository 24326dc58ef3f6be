"""Incremental operators over the operation log."""
