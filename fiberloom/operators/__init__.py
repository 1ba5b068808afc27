"""Fiberloom operators."""
