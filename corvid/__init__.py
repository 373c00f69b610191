"""corvid: a Spark-native engine for retrieval analytics over document collections."""
