"""tessellon: a Spark-native corpus-mining and dictionary-compression engine."""
