"""Recordings, label files and classifier folders as tables."""
