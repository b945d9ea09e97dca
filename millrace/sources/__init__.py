"""Readers: catalogue tables, folder walks, image files and surrogate views of the driver tables."""
