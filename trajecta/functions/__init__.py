"""Column functions of geometry, numbers and text."""
