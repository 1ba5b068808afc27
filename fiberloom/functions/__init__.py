"""Fiberloom functions."""
