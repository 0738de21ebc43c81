"""Wavelets and other scalar functions."""
