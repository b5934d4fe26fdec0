"""tessella: a Spark-native engine for routing, retrieval and evaluation of short texts."""
