"""Signals built from streams."""
