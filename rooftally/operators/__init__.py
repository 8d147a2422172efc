"""Relational operators over footprints and areas of interest."""
