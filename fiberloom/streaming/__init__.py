"""Fiberloom streaming."""
