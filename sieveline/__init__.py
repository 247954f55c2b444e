"""A Spark-native engine for building and auditing multi-annotator datasets and training corpora."""
