"""tidemark: a Spark-native engine for collecting, deduplicating and tracking short documents."""
