"""Streams into versioned tables."""
