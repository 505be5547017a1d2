"""Bounded-state operators over frame streams."""
