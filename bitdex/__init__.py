"""bitdex: a Spark-native semantic fingerprint index."""
