"""Spark-native retrieval and corpus-preparation engine over source-code collections."""
