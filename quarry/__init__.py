"""A Spark-native engine for searching, reading and checking libraries of documents."""
