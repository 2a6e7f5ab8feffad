"""A Spark-native engine for audio, embedding and text analytics."""
