"""Ridgeline: multiscale singularity analysis of series, on PySpark."""
