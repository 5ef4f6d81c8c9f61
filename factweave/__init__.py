"""A Spark-native engine for document collections, property graphs and hybrid retrieval."""
