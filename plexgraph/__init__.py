"""A Spark-native engine for knowledge graphs, vectors and retrieval over document collections."""
