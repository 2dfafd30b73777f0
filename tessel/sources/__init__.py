"""Versioned tables on files, and files of other formats."""
