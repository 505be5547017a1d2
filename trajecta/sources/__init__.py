"""Readers and writers of trajectory, depth, cloud and grid files."""
