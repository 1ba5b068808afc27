"""Fiberloom sources."""
