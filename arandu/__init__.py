"""A PySpark-native engine for document collections: read, structure, index, search and answer."""
