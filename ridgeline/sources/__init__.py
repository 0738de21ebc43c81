"""Signals from tables, text files and generators."""
