"""A PySpark-native engine for versioned, ordered, transactional tables."""
