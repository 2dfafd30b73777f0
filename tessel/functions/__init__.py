"""Column builders: ordered key bytes and ends of prefixes."""
