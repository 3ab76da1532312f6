"""A Spark-native engine that finds sensitive entities in text and replaces them by surrogates, both ways."""
